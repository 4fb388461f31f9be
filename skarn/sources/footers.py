"""Profiles of Parquet column chunks from footers and dictionaries; only chunks that these leave open are decoded."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.session import parallelism
from skarn.sources import pages

#: Physical types whose footer extrema are exact: byte arrays may be cut short, floating columns may hide NaN.
EXACT = ("BOOLEAN", "INT32", "INT64")
#: Values longer than this many bytes go on as a digest of 128 bits.
LONG = 64


def _open(uri: str):
    """An open file, through pyarrow's own file systems for anything that isn't local."""
    if uri.startswith("file:") or "://" not in uri:
        from urllib.parse import unquote, urlparse

        return pa.OSFile(unquote(urlparse(uri).path) if uri.startswith("file:") else uri)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path): the Parquet files below ``paths``. The names stay in a DataFrame; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(paths)).select("path")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column(0).to_pylist():
            with _open(uri) as f:
                meta = pq.ParquetFile(f).metadata
                sizes = [(g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(sizes), pa.string()), pa.array([g for g, _ in sizes], pa.int32()), pa.array([n for _, n in sizes], pa.int64())], ["path", "row_group", "n_rows"])


def row_groups(found: DataFrame) -> DataFrame:
    """(path, row_group, n_rows) of the files, spread evenly: a large file is no single task.

    The number of tasks is given, since the few bytes of these rows say nothing of the work behind them.
    """
    spark = found.sparkSession
    tasks = max(4 * parallelism(spark), 2 * spark.sparkContext.defaultParallelism)
    return found.mapInArrow(_groups, "path string, row_group int, n_rows bigint").where("n_rows > 0").repartition(tasks, "path", "row_group")


PROFILE = "table_no int, column string, value string, shape string, stats string"
#: Fields of ``stats`` (a JSON text, so that the many rows of values don't carry them).
STATS = (
    "is_text boolean, n_rows bigint, nulls bigint, low_i bigint, high_i bigint, low_d double, high_d double, low_t string, high_t string, "
    "footer_chunks bigint, dictionary_chunks bigint, decoded_chunks bigint, read_bytes bigint"
)


def _elements(values: pa.Array) -> Iterator[pa.Array]:
    """The flat values inside a nested column."""
    t = values.type
    if pa.types.is_map(t):
        yield from _elements(values.keys)
        yield from _elements(values.items)
    elif pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        yield from _elements(pc.list_flatten(values))
    elif pa.types.is_struct(t):
        for i in range(t.num_fields):
            yield from _elements(pc.struct_field(values, i))
    else:
        yield values


def _digests(values: pa.Array) -> pa.Array:
    """A digest for each value of a nested column; lists of numbers are hashed from their bytes."""
    t = values.type
    values = values.drop_null()
    if (pa.types.is_list(t) or pa.types.is_large_list(t)) and pa.types.is_floating(t.value_type):
        flat = pc.list_flatten(values)
        void = flat.is_null().to_numpy(zero_copy_only=False)
        x = flat.to_numpy(zero_copy_only=False) + t.value_type.to_pandas_dtype()(0)
        x[np.isnan(x)] = np.nan
        ends = np.append(0, np.cumsum(pc.list_value_length(values).to_numpy(zero_copy_only=False)))
        raw, gaps = memoryview(np.ascontiguousarray(x)).cast("B"), memoryview(void).cast("B")
        w = x.itemsize
        return pa.array([hashlib.blake2b(raw[i * w : j * w], digest_size=16, salt=hashlib.blake2b(gaps[i:j], digest_size=16).digest() if void[i:j].any() else b"").hexdigest() for i, j in zip(ends.tolist(), ends[1:].tolist())], pa.string())
    return pa.array([hashlib.blake2b(json.dumps(v, sort_keys=True, default=str).encode(), digest_size=16).hexdigest() for v in values.to_pylist()], pa.string())


def _texts(values: pa.Array) -> pa.Array:
    """Values as texts, which tell them apart: zero has one sign, and fractions of seconds no zeros at their end."""
    t = values.type
    if pa.types.is_floating(t):
        values = pc.add(values, pa.scalar(0.0, t))
    if pa.types.is_binary(t) or pa.types.is_large_binary(t):
        return pa.array([None if v is None else v.hex() for v in values.to_pylist()], pa.string())
    out = values.cast(pa.string())
    return pc.replace_substring_regex(out, r"\.?0+$", "") if pa.types.is_timestamp(t) and t.unit != "s" else out


def _short(texts: pa.Array) -> pa.Array:
    """Texts of more than LONG bytes as their digest."""
    long = pc.greater(pc.binary_length(texts), LONG)
    if not pc.any(long).as_py():
        return texts
    return pc.if_else(long, pa.array([None if few else "\0" + hashlib.blake2b(t.encode(), digest_size=16).hexdigest() for t, few in zip(texts.to_pylist(), pc.invert(long).to_pylist())], pa.string()), texts)


def _ends(values: pa.Array) -> dict:
    """Extrema of values: whole numbers, numbers or texts; NaN is no extremum."""
    t = values.type
    if pa.types.is_floating(t):
        values = values.filter(pc.invert(pc.is_nan(values)))
    whole = pa.types.is_integer(t) or pa.types.is_boolean(t)
    if not (whole or pa.types.is_floating(t) or pa.types.is_string(t) or pa.types.is_large_string(t)):
        values = _texts(values)
    m = pc.min_max(values)
    low, high = m["min"].as_py(), m["max"].as_py()
    if low is None:
        return {}
    if whole:
        return {"low_i": int(low), "high_i": int(high)}
    return {"low_d": low, "high_d": high} if pa.types.is_floating(t) else {"low_t": low, "high_t": high}


def _values(table: int, column: str, text: pa.Array, shapes: bool) -> pa.RecordBatch:
    """Rows of the distinct values of a chunk; the shape of texts: runs of letters a-z as a, runs of digits as 9."""
    n = len(text)
    shape = _short(pc.replace_substring_regex(pc.replace_substring_regex(text, "[A-Za-z]+", "a"), "[0-9]+", "9")) if shapes else pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, table, np.int32)), pa.array([column] * n, pa.string()), _short(text), shape, pa.nulls(n, pa.string())], ["table_no", "column", "value", "shape", "stats"])


def _is_text(t: pa.DataType) -> bool:
    return pa.types.is_string(t) or pa.types.is_large_string(t)


def _profile(prefixes: list[str], columns: list[str] | None):
    def one(table: int, uri: str, f, pf: pq.ParquetFile, g: int) -> Iterator[pa.RecordBatch]:
        group, schema = pf.metadata.row_group(g), pf.schema_arrow
        flat = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        stats, undecided = [], []
        for field in schema:
            if columns is not None and field.name not in columns:
                continue
            chunk = flat.get(field.name)
            if chunk is None or pa.types.is_nested(field.type):
                undecided.append(field.name)
                continue
            s = chunk.statistics
            nulls = s.null_count if s is not None and s.has_null_count else None
            row = {"column": field.name, "is_text": _is_text(field.type), "n_rows": group.num_rows, "nulls": nulls}
            exact = s is not None and s.has_min_max and chunk.physical_type in EXACT and (pa.types.is_integer(field.type) or pa.types.is_boolean(field.type))
            if nulls == group.num_rows:
                stats.append({**row, "footer_chunks": 1})
                continue
            if exact and nulls is not None and s.min == s.max:  # one value: the footer says all
                stats.append({**row, "low_i": int(s.min), "high_i": int(s.max), "footer_chunks": 1})
                yield _values(table, field.name, _texts(pa.array([s.min], field.type)), False)
                continue
            try:
                if nulls is None:
                    raise pages.Insufficient("nulls aren't counted")
                distinct, read = pages.dictionary(f, chunk, field.type)
            except pages.Insufficient:
                undecided.append(field.name)
                continue
            stats.append({**row, **_ends(distinct), "dictionary_chunks": 1, "read_bytes": read})
            yield _values(table, field.name, _texts(distinct), row["is_text"])
        for name in undecided:  # one column at a time, so that a wide row group is never held whole
            v = pf.read_row_group(g, columns=[name]).column(0).combine_chunks()
            if pa.types.is_dictionary(v.type):
                v = v.dictionary_decode()
            size = sum(c.total_compressed_size for p, c in flat.items() if p == name or p.startswith(name + "."))
            row = {"column": name, "is_text": _is_text(v.type), "n_rows": len(v), "nulls": v.null_count, "decoded_chunks": 1, "read_bytes": size}
            if pa.types.is_nested(v.type):
                ends = [_ends(e) for e in _elements(v)]
                stats.append({**row, **(ends[0] if len(ends) == 1 else {})})
                distinct = pc.unique(_digests(v))
            else:
                stats.append({**row, **_ends(v)})
                distinct = _texts(pc.unique(v).drop_null())
            if len(distinct):
                yield _values(table, name, distinct, row["is_text"])
        if stats:
            n = len(stats)
            told = [json.dumps({**{k: v for k, v in r.items() if k != "column"}, "at": f"{uri} {g}"}) for r in stats]
            yield pa.RecordBatch.from_arrays([pa.array([table] * n, pa.int32()), pa.array([r["column"] for r in stats]), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(told)], ["table_no", "column", "value", "shape", "stats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table, f, pf = None, 0, None, None
        for b in batches:
            for uri, g in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if uri != at:  # a file is opened once for all of its row groups in a batch
                    if f is not None:
                        f.close()
                    at, f = uri, _open(uri)
                    pf = pq.ParquetFile(f)
                    bare = re.sub("^file:/*", "/", uri) + "/"
                    table = max((i for i, p in enumerate(prefixes) if bare.startswith(p)), key=lambda i: len(prefixes[i]))
                yield from one(table, uri, f, pf, g)

    return run


def profile(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows (PROFILE) of all column chunks below ``paths``: the distinct values of each chunk, and its statistics in rows
    of their own without a value. table_no is the place in ``paths``."""
    prefixes = [re.sub("^file:/*", "/", p.rstrip("/")) + "/" for p in paths]
    return row_groups(files(spark, *paths)).mapInArrow(_profile(prefixes, columns), PROFILE)
