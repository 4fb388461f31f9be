"""Merging of overlapping time intervals and listing of gaps, per entity.

A partial result is a sorted list of disjoint intervals of one entity. Partial lists are made beside the scan, moved by
(entity, start) ranges, merged linearly in start order, and joined at the borders of the ranges. An entity with any
share of the rows is therefore spread over as many tasks as its rows need, and no list is ever held whole by a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from skarn.session import cut, parallelism

OPEN = np.iinfo(np.int64).max
#: Rows that a partial aggregate holds at most before it hands its lists on.
FLUSH_ROWS = 500_000
PARTIAL = "entity string, start bigint, stop bigint"
SLICES = "entity string, start bigint, stop bigint, before bigint, slice int"


def merge_sorted(code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals of rows sorted by (code, start); codes ascend. Touching intervals become one."""
    if not len(code):
        return code, start, stop
    values, rank = np.unique(stop, return_inverse=True)
    reach = np.maximum.accumulate(code.astype(np.int64) * len(values) + rank)  # codes ascend, so a new code wins
    until = values[reach - code.astype(np.int64) * len(values)]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (start[1:] > until[:-1])
    at = np.flatnonzero(first)
    return code[at], start[at], until[np.append(at[1:], len(code)) - 1]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of disjoint intervals of what one task reads."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        keys = t.column("entity").combine_chunks().dictionary_encode()
        if isinstance(keys, pa.ChunkedArray):
            keys = keys.combine_chunks()
        code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, stop = (t.column(c).to_numpy().astype(np.int64) for c in ("start", "stop"))
        order = np.lexsort((start, code))
        c, a, b = merge_sorted(code[order], start[order], stop[order])
        return pa.RecordBatch.from_arrays(
            [keys.dictionary.take(pa.array(c)).cast(pa.string()), pa.array(a), pa.array(b)], ["entity", "start", "stop"]
        )

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= FLUSH_ROWS:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def _linear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linear merge of one range in (entity, start) order; holds one batch and the open interval."""
    from pyspark import TaskContext

    slice_no = TaskContext.get().partitionId()
    open_key, open_start, open_stop, before = None, 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).cast(pa.string()).dictionary_encode()
        raw = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, stop = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2))
        runs = np.concatenate(([0], np.cumsum(raw[1:] != raw[:-1])))  # rows come sorted: ascending codes
        names = keys.dictionary.to_pylist()
        if open_key is not None and names[raw[0]] == open_key:
            runs, start, stop = np.append(0, runs), np.append(open_start, start), np.append(open_stop, stop)
            raw = np.append(raw[0], raw)
            head = before
        else:
            if open_key is not None:
                yield _rows([open_key], [open_start], [open_stop], [before], slice_no)
            head = None
        name_of = raw[np.concatenate(([True], runs[1:] != runs[:-1]))]
        c, a, z = merge_sorted(runs, start, stop)
        prior = np.empty(len(c), np.int64)
        prior[1:] = z[:-1]
        has = np.zeros(len(c), bool)
        has[1:] = c[1:] == c[:-1]
        prior[0], has[0] = (head, True) if head is not None else (0, False)
        open_key, open_start, open_stop = names[name_of[c[-1]]], int(a[-1]), int(z[-1])
        before = int(prior[-1]) if has[-1] else None
        if len(c) > 1:
            out = keys.dictionary.take(pa.array(name_of[c[:-1]]))
            yield _rows(out, a[:-1], z[:-1], pa.array(prior[:-1], mask=~has[:-1]), slice_no)
    if open_key is not None:
        yield _rows([open_key], [open_start], [open_stop], [before], slice_no)


def _rows(entity, start, stop, before, slice_no: int) -> pa.RecordBatch:
    cols = [pa.array(entity, pa.string()) if isinstance(entity, list) else entity.cast(pa.string())]
    cols += [pa.array(start, pa.int64()), pa.array(stop, pa.int64())]
    cols.append(before if isinstance(before, pa.Array) else pa.array(before, pa.int64()))
    cols.append(pa.array(np.full(len(cols[0]), slice_no, np.int32)))
    return pa.RecordBatch.from_arrays(cols, ["entity", "start", "stop", "before", "slice"])


@dataclass
class Coverage:
    """Result of :func:`cover`: ``periods`` (entity, period_from, period_until) and ``gaps`` (entity, gap_from, gap_until)."""

    periods: DataFrame
    gaps: DataFrame


def cover(df: DataFrame, entity: str, start: str, stop: str) -> Coverage:
    """Continuous periods and gaps of ``[start, stop)`` intervals per entity.

    Defined cases: a null stop is open-ended (period_until null); rows with null entity, null start or a stop not after
    the start don't count; touching intervals are continuous; repeated rows change nothing; an empty table gives empty
    results; other columns are ignored whatever their names. The empty string is an entity like any other.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(entity).cast("string").alias("entity"),
        F.col(start).cast("bigint").alias("start"),
        F.coalesce(F.col(stop).cast("bigint"), F.lit(int(OPEN))).alias("stop"),
    ).where("entity is not null and start is not null and stop > start")
    partial = rows.mapInArrow(_partial, PARTIAL)
    ranged = partial.repartitionByRange(parallelism(spark), "entity", "start").sortWithinPartitions("entity", "start")
    # Slice numbers must stay what they are when a task is repeated, so the slices are written once.
    slices = cut(ranged.mapInArrow(_linear, SLICES), "intervals")

    by_part = Window.partitionBy("entity").orderBy("slice")
    ends = slices.groupBy("entity", "slice").agg(F.max("stop").alias("top"))
    carried = ends.select(
        "entity", "slice", F.max("top").over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("carry")
    ).where("carry is not null")  # at most one row for each range border
    joined = slices.join(F.broadcast(carried), ["entity", "slice"], "left").withColumn(
        "prior", F.greatest("before", "carry")
    )
    fresh = F.col("prior").isNull() | (F.col("start") > F.col("prior"))
    gaps = joined.where("prior is not null and start > prior").select(
        "entity", F.col("prior").alias("gap_from"), F.col("start").alias("gap_until")
    )

    # A period that is the last of its slice may go on in later slices: what they add is known from the borders.
    border = joined.groupBy("entity", "slice").agg(
        F.max("stop").alias("top"),
        F.max(F.when(~fresh, F.greatest("stop", "prior"))).alias("absorbed"),
        F.count_if(fresh).alias("opened"),
        F.max(F.when(fresh, F.col("start"))).alias("last_start"),
        F.max("carry").alias("carry"),
    )
    later = by_part.rowsBetween(1, Window.unboundedFollowing)
    reach = F.when(F.col("opened") > 0, F.greatest("carry", "absorbed", F.lit(-OPEN - 1)))
    tails = border.withColumn(
        "tail", F.coalesce(F.first(reach, ignorenulls=True).over(later), F.max("top").over(later))
    ).where("tail is not null and opened > 0")
    tails = tails.select("entity", "slice", F.col("last_start").alias("start"), "tail")  # one row for each border
    periods = (
        joined.where(fresh)
        .join(F.broadcast(tails), ["entity", "slice", "start"], "left")
        .select("entity", F.col("start").alias("period_from"), F.greatest("stop", "tail").alias("u"))
        .select("entity", "period_from", F.when(F.col("u") < F.lit(int(OPEN)), F.col("u")).alias("period_until"))
    )
    return Coverage(periods, gaps)
