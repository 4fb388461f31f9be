import json

import brute
import duckdb

from skarn.operators import quality
from skarn.session import table

ROWS = "dataset_id string, snapshot_at bigint, row_no bigint, row_json string, snap string, total string"
COLS = "dataset_id string, name string, null_pct double, cardinality bigint, inferred_type string, min_value string, max_value string, updated_at bigint, column_name string"
HIST = "dataset_id string, snapshot_at bigint, columns_json string, rank string"


def cases(spark, tmp_path, rows, cols, hist):
    path = f"{tmp_path}/rows.parquet"
    spark.createDataFrame([(*r, "c", "c") for r in rows], ROWS).write.parquet(path)
    c = spark.createDataFrame([(*x, "c") for x in cols], COLS)
    h = spark.createDataFrame([(*x, "c") for x in hist], HIST)
    got = {tuple(r) for r in quality.quality_cases(spark.read.parquet(path), c, h).collect()}
    named = [dict(zip(("dataset_id", "name", "null_pct", "cardinality", "inferred_type", "min_value", "max_value", "updated_at"), x)) for x in cols]
    want = brute.quality(
        [dict(zip(("dataset_id", "snapshot_at", "row_no", "row_json"), r)) for r in rows], named, [dict(zip(("dataset_id", "snapshot_at", "columns_json"), x)) for x in hist]
    )
    return got, want


def test_checks_against_brute_force(spark, tmp_path):
    values = ["1", " 2 ", "-3", "N/A", "", None, "2.5", "1e3", "true", "FALSE", "2024-02-30", "2024-02-29x", "NULL", "na", "x-1", "y-22", "é"]
    rows = [("d", 1, i, json.dumps({"a": "old"})) for i in range(3)]
    rows += [("d", 2, i, json.dumps({"a": v, "b": str(i), "c": f"LOT-{i}" if i else "odd", **({"d": "true"} if i % 2 else {})})) for i, v in enumerate(values)]
    rows += rows[-3:]
    cols = [("d", c, 0.2, 5, "integer", "0", "16", 1) for c in "abcde"] + [("d", "b", 0.0, 17, "integer", "0", "16.0", 2), ("none", "a", 0.0, 1, "string", "a", "b", 1)]
    hist = [("d", 1, '[{"name": "a", "type": "string", "cardinality": 4, "nullPct": 0.1}, {"name": "b", "type": "integer", "cardinality": 10, "nullPct": 0}]'), ("d", 3, '[{"name": "b", "type": "integer", "cardinality": 5, "nullPct": 0.0}, {"nullPct": 0.2, "name": "c", "type": "x", "cardinality": 1}]'), ("d", 2, "{broken"), ("e", 1, "[]")]
    got, want = cases(spark, tmp_path, rows, cols, hist)
    assert got == want and len(want) > 8


def test_empty_tables(spark, tmp_path):
    assert cases(spark, tmp_path, [], [], []) == (set(), set())


def test_footer_profile_like_sql(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    o = table(spark, d, "orders").selectExpr("*", "cast(null as int) as empty")
    o.repartition(3).write.parquet(f"{tmp_path}/o.parquet")
    got = {r["column_name"]: r.asDict() for r in quality.profile_parquet(spark, {"o": f"{tmp_path}/o.parquet"}).collect()}
    con = duckdb.connect()
    for c in o.columns:
        n, nulls, distinct, low, high = con.execute(f"select count(*), count(*) - count({c}), count(distinct {c}), min({c})::varchar, max({c})::varchar from '{tmp_path}/o.parquet/*.parquet'").fetchone()
        g = got[c]
        assert (g["n_rows"], g["nulls"], g["distinct_values"]) == (n, nulls, distinct), c
        if c != "o_totalprice":
            assert (g["low"], g["high"]) == (low, high), c
    assert (got["o_orderstatus"]["dictionary_chunks"], got["o_orderstatus"]["decoded_chunks"], got["o_orderstatus"]["odd_values"]) == (3, 0, 0)
    assert (got["empty"]["footer_chunks"], got["empty"]["read_bytes"], got["empty"]["low"]) == (3, 0, None)


def chunks_of(spark, path, t, **how):
    """Profile of a written Arrow table, by column."""
    import pyarrow.parquet as pq

    pq.write_table(t, f"{path}/t.parquet", **how)
    return {r["column_name"]: r.asDict() for r in quality.profile_parquet(spark, {"t": f"{path}/t.parquet"}).collect()}


def ways(r):
    return r["footer_chunks"], r["dictionary_chunks"], r["decoded_chunks"]


def test_only_insufficient_chunks_are_decoded(spark, tmp_path):
    import os

    import pyarrow as pa

    n = 40_000
    t = pa.table({
        "few": pa.array([None if i % 7 == 0 else f"v{i % 50}" for i in range(n)]), "one": pa.array([5] * n), "none": pa.nulls(n, pa.int64()), "many": pa.array([f"text number {i} of this column" for i in range(n)]),
        "half": pa.array([f"long text {i % 20_000 if i < n // 2 else 0} of a column" for i in range(n)]), "number": pa.array([float("nan") if i == 3 else -0.0 if i == 4 else i % 9 / 2 for i in range(n)]),
        "list": pa.array([[i % 3, None] if i % 2 else None for i in range(n)]), "small": pa.array([i % 100 - 50 for i in range(n)], pa.int8()), "flag": pa.array([i % 2 == 0 for i in range(n)]),
        "unused": pa.DictionaryArray.from_arrays(pa.array([0, 1] * (n // 2)), pa.array(["a", "b", "never"])),
    })
    for codec in ("snappy", "zstd", "gzip", "none"):
        for version in ("1.0", "2.0"):
            got = chunks_of(spark, tmp_path, t, compression=codec, data_page_version=version, row_group_size=n // 2, dictionary_pagesize_limit=200_000)
            assert {c: ways(r) for c, r in got.items()} == {
                "few": (0, 2, 0), "one": (2, 0, 0), "none": (2, 0, 0), "many": (0, 0, 2), "half": (0, 1, 1), "number": (0, 2, 0), "list": (0, 0, 2), "small": (0, 2, 0), "flag": (0, 0, 2), "unused": (0, 0, 2),
            }, (codec, version)
            assert {c: r["distinct_values"] for c, r in got.items()} == {"few": 50, "one": 1, "none": 0, "many": n, "half": 20_000, "number": 10, "list": 3, "small": 100, "flag": 2, "unused": 2}
            assert (got["few"]["nulls"], got["few"]["low"], got["few"]["high"], got["small"]["low"], got["one"]["high"], got["number"]["low_number"], got["number"]["high_number"]) == (-(-n // 7), "v0", "v9", "-50", "5", 0.0, 4.0)
            assert (got["list"]["n_rows"], got["list"]["nulls"], got["list"]["low"], got["list"]["high"]) == (n, n // 2, "0", "2")
            assert got["few"]["read_bytes"] < 2_000 and got["half"]["read_bytes"] < os.path.getsize(tmp_path / "t.parquet")


def test_odd_values_are_those_of_another_shape(spark, tmp_path):
    import pyarrow as pa

    got = chunks_of(spark, tmp_path, pa.table({"a": [f"LOT-{i}" for i in range(19)] + ["odd one", None], "b": ["x", "1", "2.5"] * 7, "c": ["é" * 100 + str(i) for i in range(20)] + ["z" * 99]}))
    assert {c: r["odd_values"] for c, r in got.items()} == {"a": 1, "b": 0, "c": 1}
