"""Profiles, quality findings, validation rules and drift of tabular data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skarn.operators.quality import clean_value, column_type, value_type

SAMPLES, SAMPLE_CHARS = 5, 100


def profile(df: DataFrame, columns: list[str] | None = None, samples: bool = False) -> DataFrame:
    """One row per column: nulls, cardinality (exact), least and greatest value, mean and inferred type.

    One pass: the columns are unpivoted to (column, value) and equal values are counted before the shuffle, so that the
    exact cardinality needs no distinct per column and a column of few values moves few rows.
    """
    names = [c for c in (columns or df.columns)]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("raw")) for i, c in enumerate(names)])).alias("s")).select("s.*")
    values = cells.groupBy("position", "column_name", clean_value(F.col("raw")).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", value_type(F.col("value")))
    num = F.when(F.col("kind").isin("integer", "float"), F.col("value").try_cast("double"))
    count_of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    kinds = ("boolean", "integer", "float", "date", "string")
    aggs = [
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("value").alias("cardinality"),
        F.min(num).alias("min_number"), F.max(num).alias("max_number"), F.min("value").alias("min_text"), F.max("value").alias("max_text"),
        (F.sum(num * F.col("n")) / F.sum(F.when(num.isNotNull(), F.col("n")))).alias("mean_value"), *[count_of(k).alias(f"n_{k}") for k in kinds],
    ]
    stats = values.groupBy("position", "column_name").agg(*aggs)
    if samples:
        # The few least values by a window whose limit is pushed below the sort: no list of all values is ever made.
        short = values.where("value is not null").select("position", F.substring("value", 1, SAMPLE_CHARS).alias("s")).distinct()
        few = short.withColumn("k", F.row_number().over(Window.partitionBy("position").orderBy("s"))).where(F.col("k") <= SAMPLES)
        listed = few.groupBy("position").agg(F.array_sort(F.collect_list("s")).alias("sample_values"))
        stats = stats.join(listed, "position", "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    kind = column_type(F.col("rows"), **{k: F.col(f"n_{k}") for k in kinds})
    return stats.select(
        "position", "column_name", kind.alias("inferred_type"), F.col("rows").alias("row_count"), "null_count", (F.col("null_count") / F.col("rows")).alias("null_pct"), "cardinality",
        "min_number", "max_number", "min_text", "max_text", "mean_value", *(["sample_values"] if samples else []),
    )


def summary(p: DataFrame) -> DataFrame:
    """A sentence per profiled column."""
    unique = F.col("cardinality") / F.greatest(F.col("row_count") - F.col("null_count"), F.lit(1))
    kind = (
        F.when(F.col("inferred_type").isin("integer", "float"), F.concat(F.lit("Numeric from "), F.round("min_number", 4).cast("string"), F.lit(" to "), F.round("max_number", 4).cast("string")))
        .when(F.col("inferred_type") == "boolean", "Boolean")
        .when(F.col("inferred_type") == "date", F.concat(F.lit("Date from "), "min_text", F.lit(" to "), "max_text"))
        .when((F.col("cardinality") <= 10) & (F.col("row_count") > 20), F.concat(F.lit("Categorical of "), F.col("cardinality").cast("string"), F.lit(" values")))
        .when(unique > 0.95, "Unique text")
        .otherwise("Text")
    )
    notes = F.array_compact(F.array(F.when(F.col("cardinality") == 1, "constant"), F.when((unique > 0.95) & (F.col("cardinality") > 1), "near-unique"), F.when(F.col("null_count") > 0, F.concat(F.floor(F.col("null_pct") * 100 + 0.5).cast("string"), F.lit(" % null")))))
    return p.select("column_name", F.concat_ws("; ", kind, F.array_join(notes, "; ")).alias("summary"))


def quality(p: DataFrame) -> DataFrame:
    """Risk per profiled column from nulls, cardinality and type, at most one; with its findings."""
    pct = F.col("null_pct") * 100
    nulls = F.when(pct > 50, 0.4).when(pct > 20, 0.2).when(pct > 5, 0.1).otherwise(0.0)
    constant = (F.col("cardinality") == 1) & (F.col("row_count") > 10)
    spread = F.when(constant, 0.3).when((F.col("cardinality") == F.col("row_count")) & (F.col("inferred_type") == "string"), 0.1).otherwise(0.0)
    kind = F.when(F.col("inferred_type") == "mixed", 0.05).otherwise(0.0)
    found = F.array_compact(F.array(F.when(nulls > 0, "nulls"), F.when(constant, "constant"), F.when(spread == 0.1, "all distinct"), F.when(kind > 0, "mixed types")))
    return p.select("column_name", F.round(F.least(nulls + spread + kind, F.lit(1.0)), 4).alias("risk"), F.array_join(found, ", ").alias("findings"))


def rules(p: DataFrame) -> DataFrame:
    """Validation rules that the data suggest: (column_name, rule)."""
    out = F.array_compact(
        F.array(
            F.when(F.col("null_count") == 0, "required"),
            F.when((F.col("null_pct") > 0) & (F.col("null_pct") < 0.01), "rarely null"),
            F.when(F.col("inferred_type").isin("integer", "float", "boolean", "date"), F.concat(F.lit("type "), "inferred_type")),
            F.when(F.col("inferred_type").isin("integer", "float"), F.concat(F.lit("range "), F.round("min_number", 4).cast("string"), F.lit(" .. "), F.round("max_number", 4).cast("string"))),
            F.when((F.col("cardinality") <= 20) & (F.col("row_count") > 50), "enumeration"),
            F.when(F.col("cardinality") == F.col("row_count"), "unique"),
        )
    )
    return p.select("column_name", F.explode(out).alias("rule"))


def search_columns(columns: DataFrame, term: str) -> DataFrame:
    """Catalog columns whose name, samples or summary hold the term."""
    t = term.lower()
    return columns.where(F.lower("name").contains(t) | F.lower(F.array_join("sample_values", " ")).contains(t) | F.lower("summary").contains(t))


def history(snapshots: DataFrame, n: int) -> DataFrame:
    """The last ``n`` snapshots of each dataset, newest first; repeated snapshots count once."""
    once = snapshots.dropDuplicates(["dataset_id", "snapshot_at"])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("snapshot_at")))).where(F.col("rank") <= n)


def row_delta(snapshots: DataFrame) -> DataFrame:
    """Change of the row count between the last two snapshots of each dataset."""
    last = history(snapshots.select("dataset_id", "snapshot_at", "row_count"), 2)
    return last.groupBy("dataset_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("row_count"))).alias("rows_now"), F.max(F.when(F.col("rank") == 2, F.col("row_count"))).alias("rows_before")
    ).where("rows_before is not null").withColumn("delta", F.col("rows_now") - F.col("rows_before"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts per value with their share of all rows in per cent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select(column, "n", F.round(F.col("n") * 100 / total, 2).alias("percent"))


def sniff(raw: Column) -> Column:
    """The type of a raw text value: null, boolean, integer, float, date or string."""
    v = clean_value(raw)
    return F.coalesce(value_type(v), F.lit("null"))

