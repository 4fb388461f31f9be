"""Guards against hot keys: detection with a bounded result, and joins that spread a hot key over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is hot from this share of the rows on, so that at most 64 keys can be hot and their list may be broadcast.
HOT_SHARE = 1 / 64
#: Number of tasks over which a hot key is spread.
SALTS = 32


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of all rows with a key: at most 1/share rows (column ``hot_key``).

    Counts are combined before the shuffle. The total is a scalar subquery, so the threshold needs no action and no join.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg((F.sum("n") * F.lit(share)).alias("least")).scalar()
    return counts.where(F.col("n") >= least).select("hot_key")


def salted_join(
    many: DataFrame, few: DataFrame, key: str, how: str = "left", salts: int = SALTS, hot: DataFrame | None = None
) -> DataFrame:
    """Join ``many`` (may have hot keys) to ``few`` (unique by ``key``) without a hot task.

    Rows of a hot key in ``many`` get a salt; the one row of that key in ``few`` is repeated for each salt. The
    broadcast list of hot keys has at most 1/HOT_SHARE rows whatever the size of the data.
    """
    if how not in ("left", "inner"):
        raise ValueError("salted_join supports left and inner joins")
    hot = F.broadcast((hot_keys(many, key) if hot is None else hot).withColumn("__hot", F.lit(True)))
    salt: Column = F.when(F.col("__hot"), F.floor(F.rand(7) * salts)).otherwise(F.lit(0)).cast("int")
    left = many.join(hot, many[key] == hot["hot_key"], "left").withColumn("__salt", salt).drop("hot_key", "__hot")
    spread = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(hot, few[key] == hot["hot_key"], "left").withColumn("__salt", F.explode(spread))
    right = right.drop("hot_key", "__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def hashed_sample(df: DataFrame, keys: list[str], rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, picked by the hash of columns: the same rows on every run, found by a filter.

    Unlike an ordered limit it sends no candidates of every partition to one place. The columns should tell rows apart.
    """
    if total <= rows:
        return df
    span = 1 << 40
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(span)) < F.lit(int(span * rows / total)))


def current_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` per key; null keys are left out, repeated rows count once.

    One aggregate with partial results (no window), so a key with very many states is no hot task; rows with texts are
    sorted for it on both sides of the shuffle. Equal ``order`` values are settled by the greatest remaining columns,
    which makes the result independent of row order.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    top = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("__top")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(top).select(*keys, "__top.*")


def carried(df: DataFrame, key: str, order: list[str], value: str, out: str, inclusive: bool) -> DataFrame:
    """Adds ``out``: the last value that isn't null before each row (or up to it) among the rows of its key in an order.

    Rows are cut into ranges of (key, order), so that a key with a great share of all rows lies in many of them. Within a
    range a window carries values on; over the borders, the last value of each earlier range of the key does. An order
    with ties needs further columns to be repeatable.
    """
    from pyspark.sql.window import Window

    from skarn.session import cut, parallelism

    ranged = cut(df.repartitionByRange(parallelism(df.sparkSession), key, *order).withColumn("__slice", F.spark_partition_id()), "ranges")
    w = Window.partitionBy(key, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = ranged.withColumn("__in", F.last(value, ignorenulls=True).over(w))
    ends = ranged.where(F.col(value).isNotNull()).groupBy(key, "__slice").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    spans = ranged.select(key, "__slice").distinct().join(ends, [key, "__slice"], "left")
    before = spans.withColumn("__before", F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)))
    # One row for each border that a key lies on: as many as there are ranges.
    borders = F.broadcast(before.where("__before is not null").select(key, "__slice", "__before"))
    return inner.join(borders, [key, "__slice"], "left").withColumn(out, F.coalesce("__in", "__before")).drop("__slice", "__in", "__before")


def running_sum(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of a key's values up to each row in an order, over ranges like :func:`carried`."""
    from pyspark.sql.window import Window

    from skarn.session import cut, parallelism

    ranged = cut(df.repartitionByRange(parallelism(df.sparkSession), key, *order).withColumn("__slice", F.spark_partition_id()), "ranges")
    inner = ranged.withColumn("__in", F.sum(value).over(Window.partitionBy(key, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = ranged.groupBy(key, "__slice").agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)))
    borders = F.broadcast(before.where("__before is not null").select(key, "__slice", "__before"))
    return inner.join(borders, [key, "__slice"], "left").withColumn(out, F.coalesce(F.col("__in") + F.coalesce("__before", F.lit(0)), "__before")).drop("__slice", "__in", "__before")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the place of each row in an order, from 0, over ranges like :func:`carried`."""
    from pyspark.sql.window import Window

    from skarn.session import cut, parallelism

    ranged = cut(df.repartitionByRange(parallelism(df.sparkSession), *order).withColumn("__slice", F.spark_partition_id()), "ranges")
    # One row for each range.
    sizes = ranged.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__slice", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__slice").orderBy(*order))
    return ranged.withColumn("__in", place).join(F.broadcast(before), "__slice").withColumn(out, F.col("__before") + F.col("__in") - 1).drop("__slice", "__in", "__before")
