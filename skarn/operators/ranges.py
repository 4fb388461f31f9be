"""Joins on ranges, innermost ranges, prefixes and times, each with an equality that Spark can hash or sort on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skarn.skew import carried

#: Lines per bucket; a range is listed in every level-one bucket it touches, a point in one.
BUCKET = 64


def _bucketed(df: DataFrame, start: str, stop: str, bucket: int = BUCKET) -> DataFrame:
    lo, hi = F.floor(F.col(start) / bucket), F.floor(F.col(stop) / bucket)
    return df.where(F.col(start) <= F.col(stop)).withColumn("__bucket", F.explode(F.sequence(lo, hi)))


def points_in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, stop: str, bucket: int = BUCKET) -> DataFrame:
    """Points with every range of the same key that holds them; an equi-join on (key, bucket) with a range residual."""
    p = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__bucket", F.floor(F.col(at) / bucket))
    r = _bucketed(ranges, start, stop, bucket)
    return p.join(r, [key, "__bucket"]).where(F.col(at).between(F.col(start), F.col(stop))).drop("__bucket")


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str, stop: str, r_start: str, r_stop: str) -> DataFrame:
    """Pairs of ranges of one key that share a point. Two overlapping ranges share the bucket in which the later one of
    them starts, so each pair is met once."""
    l, r = _bucketed(left, start, stop), _bucketed(right, r_start, r_stop)
    j = l.join(r, [key, "__bucket"]).where((F.col(start) <= F.col(r_stop)) & (F.col(r_start) <= F.col(stop)))
    return j.where(F.col("__bucket") == F.floor(F.greatest(F.col(start), F.col(r_start)) / BUCKET)).drop("__bucket")


def containing(df: DataFrame, key: str, start: str, stop: str, id: str) -> DataFrame:
    """Pairs (outer_id, inner_id) of one key whose ranges nest and differ in length. The inner start is the point."""
    inner = df.select(key, F.col(id).alias("inner_id"), F.col(start).alias("__s"), F.col(stop).alias("__e"))
    outer = df.select(key, F.col(id).alias("outer_id"), F.col(start).alias("__os"), F.col(stop).alias("__oe"))
    j = points_in_ranges(inner, outer, key, "__s", "__os", "__oe")
    return j.where((F.col("__oe") >= F.col("__e")) & (F.col("__oe") - F.col("__os") > F.col("__e") - F.col("__s")) & (F.col("outer_id") != F.col("inner_id"))).select("outer_id", "inner_id")


def innermost(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, stop: str, point_id: str, range_id: str) -> DataFrame:
    """The shortest range around each point: (point_id, node_id); ties by the smaller id. Aggregated with partial results."""
    j = points_in_ranges(points, ranges, key, at, start, stop).where(F.col(point_id) != F.col(range_id))
    return j.groupBy(point_id).agg(F.min(F.struct((F.col(stop) - F.col(start)).alias("span"), F.col(range_id).alias("node_id"))).alias("m")).select(point_id, "m.node_id")


def longest_prefix(values: DataFrame, prefixes: DataFrame, value: str, prefix: str, separator: str = "/") -> DataFrame:
    """The longest prefix that ends before a separator: (value, longest). Prefixes are listed and joined by equality."""
    parts = F.split(F.col(value), f"\\Q{separator}\\E")
    listed = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    own = values.where(F.size(parts) > 1).select(value, F.explode(listed).alias(prefix))
    return own.join(prefixes.select(prefix).distinct(), prefix).groupBy(value).agg(F.expr(f"max_by({prefix}, length({prefix}))").alias("longest"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, columns: list[str]) -> DataFrame:
    """For each left row the latest right row of the key at or before its time (nulls where there is none).

    Both sides are put into one ordered stream per key and carried forward, so there is no product of the two; a key with
    very many rows is cut into ranges of time.
    """
    held = F.struct(*[F.col(c) for c in columns])
    l = left.select(*left.columns, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType).alias("__r"))
    r = right.select(*[F.col(c) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_at).alias("__t"), F.lit(0).alias("__side"), held.alias("__r"))
    out = carried(l.unionByName(r), key, ["__t", "__side"], "__r", "__last", inclusive=True).where("__side = 1")
    return out.select(*left.columns, *[F.col(f"__last.{c}").alias(c) for c in columns])
