"""Column-level data quality: profiles, claims checked against rows, drift between loads.

Parquet columns are profiled chunk by chunk (:func:`profile_parquet`): footers give null counts and extrema where they
are exact, dictionary pages give the distinct candidates, and only chunks that these leave open are decoded. Values kept
as text in JSON have no chunk of their own, so their chunks are always insufficient and are scanned
(:func:`profile_json`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from skarn.skew import current_rows
from skarn.sources import footers

# Texts that mean null, in lower case.
NULL_WORDS = ["", "null", "na", "n/a"]
# White space of Unicode.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def clean_value(c: Column) -> Column:
    """The value without outer blanks; null for the words that mean null."""
    v = F.btrim(c, F.lit(BLANKS))
    return F.when(~F.lower(v).isin(NULL_WORDS), v)


def value_type(v: Column) -> Column:
    """boolean, integer, float, date or string of one clean value."""
    day = F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd"))
    return (
        F.when(v.isNull(), None)
        .when(F.lower(v).isin("true", "false"), "boolean")
        .when(v.rlike(r"\A-?\d+\z"), "integer")
        .when(v.rlike(r"\A-?\d+\.\d+\z|\A-?\d+[eE][+-]?\d+\z"), "float")
        .when(v.rlike(r"\A\d{4}-\d{2}-\d{2}") & day.isNotNull(), "date")
        .otherwise("string")
    )


def column_type(total: Column, **of: Column) -> Column:
    """Type of a column from the counts of its values' types; a type needs more than 80 % of all rows, nulls included."""
    seen = F.array(*[F.when(n > 0, F.lit(t)) for t, n in of.items()])
    seen = F.array_compact(seen)
    major = F.coalesce(*[F.when(n > total * 0.8, F.lit(t)) for t, n in of.items()])
    return (
        F.when(F.size(seen) == 0, "null")
        .when(F.size(seen) == 1, F.element_at(seen, 1))
        .when((F.size(seen) == 2) & F.array_contains(seen, "integer") & F.array_contains(seen, "float"), "float")
        .when(major.isNotNull(), major)
        .otherwise("mixed")
    )


def shape(v: Column) -> Column:
    """Runs of letters a-z in any case as a, runs of digits as 9, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(v, "[A-Za-z]+", "a"), "[0-9]+", "9")


TYPES = ("boolean", "integer", "float", "date", "string")


def profile_json(rows: DataFrame, wanted: DataFrame, dataset: str = "dataset_id", snapshot: str = "snapshot_at", row: str = "row_no", json: str = "row_json") -> DataFrame:
    """Profile of the latest snapshot of each dataset, for the columns in ``wanted`` (dataset_id, column_name).

    Equal values are counted before anything else (partial counts precede the shuffle), so that the profile of a column
    works on distinct values, and a dataset with a great share of all rows is spread by column and value. Absent keys
    are nulls: a column's nulls are the snapshot's rows less its values. Broken JSON counts as a row of nulls.
    """
    latest = rows.groupBy(dataset).agg(F.max(snapshot).alias("snap"))
    keyed = rows.select(F.col(dataset).alias("dataset_id"), F.col(snapshot).alias("snap"), F.col(row).alias("row_no"), F.col(json).alias("json"))
    now = keyed.join(latest.withColumnRenamed(dataset, "dataset_id"), ["dataset_id", "snap"], "left_semi")
    once = now.groupBy("dataset_id", "snap", "row_no").agg(F.max("json").alias("json"))
    sizes = once.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total"))
    fields = once.select("dataset_id", F.explode(F.from_json("json", T.MapType(T.StringType(), T.StringType()), {"allowNumericLeadingZeros": "true"})).alias("column_name", "raw"))
    values = (
        fields.select("dataset_id", "column_name", clean_value(F.col("raw")).alias("value")).where("value is not null")
        .groupBy("dataset_id", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("kind", value_type(F.col("value"))).withColumn("shape", shape(F.col("value")))
    )
    num = F.when(F.col("kind").isin("integer", "float"), F.expr("try_cast(value as double)"))
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == t, F.col("n"))), F.lit(0)).alias(f"n_{t}") for t in TYPES]
    by_shape = values.groupBy("dataset_id", "column_name", "shape").agg(
        F.sum("n").alias("of_shape"), F.count(F.lit(1)).alias("distinct_values"), F.min(num).alias("low"), F.max(num).alias("high"), *counts
    )
    stats = by_shape.groupBy("dataset_id", "column_name").agg(
        F.sum("of_shape").alias("filled"), F.sum("distinct_values").alias("distinct_values"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.max("of_shape").alias("top_shape"), *[F.sum(f"n_{t}").alias(f"n_{t}") for t in TYPES],
    )
    out = wanted.select("dataset_id", "column_name").distinct().join(sizes, "dataset_id").join(stats, ["dataset_id", "column_name"], "left")
    n = {t: F.coalesce(f"n_{t}", F.lit(0)) for t in TYPES}
    return out.select(
        "dataset_id", "column_name", "total", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("distinct_values", F.lit(0)).alias("cardinality"),
        "low", "high", F.coalesce("top_shape", F.lit(0)).alias("top_shape"), column_type(F.col("total"), **n).alias("column_type"),
    )


def check_claims(profile: DataFrame, claims: DataFrame) -> DataFrame:
    """(dataset_id, column_name, check_name) where the stored profile disagrees with the rows, or a pattern is violated."""
    c = claims.select(
        F.col("dataset_id"), F.col("name").alias("column_name"), F.col("null_pct").alias("c_null"), F.col("cardinality").alias("c_card"),
        F.col("inferred_type").alias("c_type"), F.expr("try_cast(trim(min_value) as double)").alias("c_low"), F.expr("try_cast(trim(max_value) as double)").alias("c_high"),
    )
    j = c.join(profile, ["dataset_id", "column_name"])
    share = (F.col("total") - F.col("filled")) / F.col("total")
    is_number = F.col("column_type").isin("integer", "float")
    checks = {
        "null_pct": F.col("c_null").isNull() | (F.abs(F.col("c_null") - share) > F.lit(0.01 + 1e-12)),
        "cardinality": ~F.col("c_card").eqNullSafe(F.col("cardinality")),
        "inferred_type": ~F.col("c_type").eqNullSafe(F.col("column_type")),
        "range": is_number & ~(F.col("c_low").eqNullSafe(F.col("low")) & F.col("c_high").eqNullSafe(F.col("high"))),
        "pattern": F.col("column_type").isin("string", "date") & (F.col("top_shape") >= F.col("filled") * 0.9) & (F.col("top_shape") < F.col("filled")),
    }
    named = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]))
    return j.select("dataset_id", "column_name", F.explode(named).alias("check_name"))


HISTORY = "array<struct<name string, type string, cardinality double, nullPct double>>"


def drift(history: DataFrame) -> DataFrame:
    """(dataset_id, column_name, what) between the last two readable snapshots of each dataset.

    Unreadable JSON is no snapshot; repeated snapshots count once; a dataset with one snapshot has no drift. Only two
    rows per dataset survive the window, whose limit is pushed below the sort.
    """
    readable = history.select("dataset_id", "snapshot_at", "columns_json", F.from_json("columns_json", HISTORY, {"mode": "PERMISSIVE"}).alias("cols"))
    whole = F.try_parse_json("columns_json")
    readable = readable.where(whole.isNotNull() & F.col("cols").isNotNull() & F.col("dataset_id").isNotNull() & F.col("snapshot_at").isNotNull())
    once = readable.groupBy("dataset_id", "snapshot_at").agg(F.max("columns_json").alias("json"))
    last = once.withColumn("rank", F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("snapshot_at")))).where("rank <= 2")
    cols = last.select("dataset_id", "rank", F.explode(F.from_json("json", HISTORY)).alias("c")).where("c.name is not null")
    both = last.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("loads")).where("loads = 2").select("dataset_id")
    # One aggregate instead of a self-join: the two sides of a column meet in one group.
    side = cols.groupBy("dataset_id", F.col("c.name").alias("column_name")).agg(
        *[F.max(F.when(F.col("rank") == r, F.col("c"))).alias(name) for r, name in ((1, "new"), (2, "old"))]
    )
    card = (F.col("new.cardinality"), F.col("old.cardinality"))
    what = (
        F.when(F.col("new").isNull() | F.col("old").isNull(), F.when(F.col("new").isNull(), "removed").otherwise("added"))
        .when(~F.col("new.type").eqNullSafe(F.col("old.type")), "type")
        .when(F.abs(F.col("new.nullPct") - F.col("old.nullPct")) > F.lit(0.05 + 1e-12), "null_pct")
        .when((card[0] != card[1]) & (F.greatest(*card) >= F.least(*card) * 2), "cardinality")
    )
    return side.withColumn("what", what).where("what is not null").join(both, "dataset_id", "left_semi").select("dataset_id", "column_name", "what")


def quality_cases(rows: DataFrame, columns: DataFrame, history: DataFrame) -> DataFrame:
    """All failed checks of the datasets' columns: (dataset_id, column_name, check_name)."""
    claims = current_rows(columns.select("dataset_id", "name", "null_pct", "cardinality", "inferred_type", "min_value", "max_value", "updated_at"), ["dataset_id", "name"], "updated_at")
    wanted = claims.select("dataset_id", F.col("name").alias("column_name"))
    # The values are inside JSON: no footer and no dictionary tells them, so every chunk is insufficient and is scanned.
    checked = check_claims(profile_json(rows, wanted), claims)
    drifted = drift(history).select("dataset_id", "column_name", F.lit("drift").alias("check_name"))
    return checked.unionByName(drifted)


def profile_parquet(spark: SparkSession, tables: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Profile of every column of Parquet tables (name to path):
    (table_name, column_name, n_rows, nulls, distinct_values, low, high, low_number, high_number, odd_values,
    footer_chunks, dictionary_chunks, decoded_chunks, read_bytes).

    Per chunk: nulls come from the footer; a chunk of nulls or of one whole number is settled by it. Otherwise the
    dictionary page gives the distinct values, and with them the extrema, if every data page refers to it. All other
    chunks, and nested ones, are decoded, and the last four columns tell how many chunks went which way. low and high
    are exact texts, of floating columns low_number and high_number (without NaN). odd_values: distinct texts that
    don't have the shape of at least 90 % of them, or 0 where no shape has that share. A nested column counts whole values,
    and its extrema are those of its elements (if it has one kind of them).
    """
    rows = footers.profile(spark, list(tables.values()), columns)
    # Equal values of chunks meet first, then values of a shape: both by hash, whatever the length of the texts was.
    once = rows.groupBy("table_no", "column", "value", "shape", "stats").agg(F.count("value").alias("chunks"))
    by_shape = once.groupBy("table_no", "column", "shape", "stats").agg(F.count("value").alias("n_values"))
    told = by_shape.select("table_no", "column", "shape", "n_values", F.from_json("stats", footers.STATS).alias("s")).select("*", "s.*")
    sums = ("n_rows", "nulls", "footer_chunks", "dictionary_chunks", "decoded_chunks", "read_bytes")
    stats = [*[F.sum(c).alias(c) for c in sums], *[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in ("low_i", "low_d", "low_t", "high_i", "high_d", "high_t")]]
    whole = told.groupBy("table_no", "column").agg(*stats, F.sum("n_values").alias("distinct_values"), F.max(F.when(F.col("shape").isNotNull(), F.col("n_values"))).alias("top"), F.max("is_text").alias("text"))
    name = F.try_element_at(F.array(*[F.lit(n) for n in tables]), F.col("table_no") + 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.select(
        name.alias("table_name"), F.col("column").alias("column_name"), zero("n_rows"), zero("nulls"), "distinct_values",
        F.coalesce(F.col("low_i").cast("string"), "low_t").alias("low"), F.coalesce(F.col("high_i").cast("string"), "high_t").alias("high"),
        F.col("low_d").alias("low_number"), F.col("high_d").alias("high_number"),
        F.when(F.col("text") & (F.col("top") >= F.col("distinct_values") * 0.9), F.col("distinct_values") - F.col("top")).otherwise(0).alias("odd_values"),
        *map(zero, ("footer_chunks", "dictionary_chunks", "decoded_chunks", "read_bytes")),
    )
