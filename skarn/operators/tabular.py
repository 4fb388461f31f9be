"""Filters, projections, joins and grouped aggregates over datasets, with typed comparisons.

Filters are (column, op, value) triples that are all required; columns are validated before a plan is built, so that a
wrong name is an error here and not deep in a job. Everything compiles to built-in expressions: predicates and column
lists reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "in", "is_null", "between")
METRICS = ("count", "count_distinct", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column {missing[0]!r}; available: {', '.join(df.columns)}")


def predicate(df: DataFrame, f: Filter) -> Column:
    """One filter as a condition. A null never matches, but for ``is_null``."""
    check_columns(df, [f.column])
    c, v = df[f.column], f.value
    if f.op == "eq":
        return c == v
    if f.op == "neq":
        return c != v
    if f.op == "gt":
        return c > v
    if f.op == "gte":
        return c >= v
    if f.op == "lt":
        return c < v
    if f.op == "lte":
        return c <= v
    if f.op == "contains":
        return c.cast("string").ilike(f"%{v}%")  # % and _ of the value stay wildcards
    if f.op == "in":
        return c.isin(list(v)) if isinstance(v, (list, tuple, set)) and len(v) else F.lit(False)
    if f.op == "is_null":
        return c.isNull() if v is True or v == "true" else c.isNotNull()
    if f.op == "between":
        if not isinstance(v, (list, tuple)) or len(v) != 2:
            raise ValueError("between needs two values")
        return c.between(v[0], v[1])
    raise ValueError(f"unknown filter {f.op!r}; available: {', '.join(OPS)}")


def parse_filter(text: str) -> Filter:
    """``column:op:value``; the value may hold colons and is a string."""
    parts = text.split(":", 2)
    if len(parts) < 2:
        raise ValueError("a filter is column:op:value")
    return Filter(parts[0], parts[1], parts[2] if len(parts) > 2 else "")


def where(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return df.where(reduce(Column.__and__, [predicate(df, f) for f in filters])) if filters else df


def project(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    check_columns(df, columns or [])
    return df.select(*columns) if columns else df


def query_rows(df: DataFrame, filters: Sequence[Filter] = (), columns: Sequence[str] | None = None, order: Sequence[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of the matching rows. Paging needs a total order to be repeatable; without one it is refused."""
    out = where(df, filters)
    if limit is not None or offset:
        if not order:
            raise ValueError("a page needs an order")
        check_columns(df, list(order))
        out = out.orderBy(*order)
        if offset:
            out = out.offset(offset)
        if limit is not None:
            out = out.limit(limit)
    return project(out, columns)


def count_rows(df: DataFrame, filters: Sequence[Filter] = ()) -> DataFrame:
    return where(df, filters).agg(F.count(F.lit(1)).alias("total_matching"))


def metric(df: DataFrame, op: str, column: str) -> Column:
    """An aggregate; sums and means over text read it as numbers, and what is no number as null."""
    if op not in METRICS:
        raise ValueError(f"unknown metric {op!r}; available: {', '.join(METRICS)}")
    if column == "*":
        if op != "count":
            raise ValueError("only count takes *")
        return F.count(F.lit(1))
    check_columns(df, [column])
    number = F.col(column).try_cast("double")
    return {"count": F.count, "count_distinct": F.count_distinct, "sum": lambda _: F.sum(number), "avg": lambda _: F.avg(number), "min": F.min, "max": F.max}[op](F.col(column))


def aggregate(df: DataFrame, group_by: Sequence[str] = (), metrics: Sequence[tuple] = (), filters: Sequence[Filter] = (), having: str | None = None) -> DataFrame:
    """Grouped aggregates: metrics are (op, column[, alias]), the alias defaults to op_column."""
    rows = where(df, filters)
    check_columns(df, list(group_by))
    cols = [metric(df, m[0], m[1]).alias(m[2] if len(m) > 2 else f"{m[0]}_{m[1]}") for m in metrics]
    out = rows.groupBy(*group_by).agg(*cols)
    return out.where(having) if having else out


def join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, how: str = "inner", columns: Sequence[str] | None = None, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """Equi-join with columns named ``dataset.column``. A bare column name is looked up on the left, then the right."""
    if how not in ("inner", "left", "right"):
        raise ValueError("joins are inner, left or right")
    check_columns(left, [left_column])
    check_columns(right, [right_column])
    l = left.select(*[F.col(f"`{c}`").alias(f"{left_name}.{c}") for c in left.columns])
    r = right.select(*[F.col(f"`{c}`").alias(f"{right_name}.{c}") for c in right.columns])
    out = l.join(r, l[f"`{left_name}.{left_column}`"] == r[f"`{right_name}.{right_column}`"], how)
    if columns is None:
        return out
    chosen = []
    for c in columns:
        name = next((n for n in (c, f"{left_name}.{c}", f"{right_name}.{c}") if n in out.columns), None)
        if name is None:
            raise ValueError(f"unknown column {c!r}; available: {', '.join(out.columns)}")
        chosen.append(F.col(f"`{name}`"))
    return out.select(*chosen)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a total order; planned as a top-k per partition and a merge."""
    return df.orderBy(*order).limit(n)


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient sum((2i - n - 1) x) / (n sum(x)) over ascending values, as one row; null below two values.

    Equal values share a mean rank, so the ranks follow from counts per value; only distinct values are sorted, and
    their running count is made range by range.
    """
    from skarn.session import cut, parallelism
    from pyspark.sql.window import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    ranged = cut(counts.repartitionByRange(parallelism(df.sparkSession), "x").withColumn("slice", F.spark_partition_id()), "gini")
    before = ranged.groupBy("slice").agg(F.sum("c").alias("n")).select(
        "slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")
    )  # one row per slice
    inner = F.sum("c").over(Window.partitionBy("slice").orderBy("x"))
    placed = ranged.withColumn("upto", inner).join(F.broadcast(before), "slice").withColumn("first", F.col("earlier") + F.col("upto") - F.col("c"))
    # The ranks of a value are first + 1 .. first + c; their sum is c * first + c (c + 1) / 2.
    sums = placed.agg(
        F.sum("c").alias("n"),
        F.sum(F.col("x") * F.col("c")).alias("total"),
        F.sum(F.col("x") * (F.col("c") * F.col("first") + F.col("c") * (F.col("c") + 1) / 2)).alias("ranked"),
    )
    g = (2 * F.col("ranked") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") < 2, None).when(F.col("total") == 0, 0.0).otherwise(g).alias("gini"))


def extremes(df: DataFrame, id: str, value: str, n: int = 5) -> DataFrame:
    """The ``n`` greatest and least values with their ids: (side, rank, id, value); nulls are neither."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(id).alias("id"), F.col(value).alias("value"))
    out = None
    for side, order in (("top", F.desc("value")), ("bottom", F.asc("value"))):
        few = rows.orderBy(order, "id").limit(n)  # a top-k per partition and a merge
        ranked = few.agg(F.array_sort(F.collect_list(F.struct((-F.col("value") if side == "top" else F.col("value")).alias("key"), "id", "value"))).alias("s"))
        part = ranked.select(F.lit(side).alias("side"), F.posexplode("s").alias("rank", "x")).select("side", (F.col("rank") + 1).alias("rank"), "x.id", "x.value")
        out = part if out is None else out.unionByName(part)
    return out


def correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """Pearson correlation of all pairs of columns in one pass: (column_a, column_b, r, n, strength), |r| at least threshold."""
    check_columns(df, list(columns))
    num = {c: F.col(c).try_cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in list(columns)[i + 1 :]]
    both = {(a, b): num[a].isNotNull() & num[b].isNotNull() for a, b in pairs}
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.when(both[a, b], num[a]), F.when(both[a, b], num[b])
        aggs += [F.corr(x, y).alias(f"r{i}"), F.count_if(both[a, b]).alias(f"n{i}")]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double, n bigint, strength string")
    row = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(f"r{i}", 4).alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
    size = F.abs(F.col("r"))
    strength = F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("none")
    return row.select(F.inline(entries)).where((F.col("n") >= 3) & (size >= threshold)).withColumn("strength", strength)
