"""Streaming forms: windows with watermarks, deduplication, sessions by start time, thresholds, merges per batch.

Each function takes a (streaming or plain) DataFrame and returns one; :func:`drain` runs a stream over what is there and
ends, with its state in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skarn.session import removed_at_exit, shared_dir


def tumbling(events: DataFrame, at: str = "ts", width: str = "1 day", late: str = "2 days", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums per window; rows later than the watermark are dropped by the engine."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str = "ts", width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def gap_sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "2 hours", late: str = "2 days") -> DataFrame:
    """Sessions that end after a pause."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def once(events: DataFrame, keys: list[str], at: str | None = None, late: str = "2 days") -> DataFrame:
    """First event per key; with a time column the state is bounded by the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if at else events.dropDuplicates(keys)


STARTED = "user_id bigint, session_start timestamp, n bigint"


def started_sessions(events: DataFrame, seconds: int = 7200) -> DataFrame:
    """Sessions reused while they *began* at most ``seconds`` ago, as (user_id, session_start, n) per batch and session.

    The state per user is the open session's start and size, whatever the number of events.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        out = []
        times = pd.concat([f["ts"] for f in frames]).sort_values()
        for t in times:
            if start is None or (t - start).total_seconds() > seconds:
                if start is not None:
                    out.append((key[0], start, n))
                start, n = t, 0
            n += 1
        state.update((start, n))
        out.append((key[0], start, n))
        yield pd.DataFrame(out, columns=["user_id", "session_start", "n"])

    return events.groupBy("user_id").applyInPandasWithState(step, STARTED, "start timestamp, n bigint", "update", GroupStateTimeout.NoTimeout)


def started_sessions_batch(events: DataFrame, seconds: int = 7200) -> DataFrame:
    """The same sessions over a finished table: (user_id, session_start, n).

    A session's end depends on its start, so a user's events are folded in order: rows are sorted within partitions and
    read batch by batch with the open session as the only state. The fold jumps from session to session.
    """
    width = seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, start, n = None, 0, 0
        for b in batches:
            users, times = b.column(0).to_numpy(zero_copy_only=False), b.column(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            edges = np.flatnonzero(np.append(True, users[1:] != users[:-1])) if len(users) else []
            for lo, hi in zip(edges, [*edges[1:], len(users)]):
                t = times[lo:hi]
                if user is None or users[lo] != user:
                    if user is not None:
                        out.append((user, start, n))
                    user, start, n = int(users[lo]), int(t[0]), 0
                i = 0
                while i < len(t):
                    j = int(np.searchsorted(t, start + width, side="right"))
                    n += max(0, j - i)
                    i = max(i, j)
                    if i < len(t):
                        out.append((user, start, n))
                        start, n = int(t[i]), 0
            yield _session_rows(out)
        if user is not None:
            yield _session_rows([(user, start, n)])

    rows = events.where("user_id is not null and ts is not null").select(F.col("user_id").cast("bigint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    sessions = rows.repartition("user_id").sortWithinPartitions("user_id", "ts").mapInArrow(fold, "user_id bigint, at bigint, n bigint")
    return sessions.select("user_id", F.timestamp_micros("at").alias("session_start"), "n")


def _session_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["user_id", "at", "n"])


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input, then end; the result is read back as a table."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    removed_at_exit(spark, at)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode).start()
    q.awaitTermination()
    from pyspark.sql.types import IntegerType

    return spark.read.schema(stream.schema.add("batch", IntegerType())).parquet(f"{at}/out")


def stream_table(spark, d: str, name: str, **options: str) -> DataFrame:
    """A table's file or folder as a stream."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    import os

    stream = spark.readStream.schema(schema).options(**options)
    rows = stream.option("pathGlobFilter", f"{name}.parquet").parquet(d) if os.path.isfile(path) else stream.parquet(path)
    return with_zone(rows)


def with_zone(events: DataFrame) -> DataFrame:
    """Times without a zone read in the session's zone: windows and watermarks need instants."""
    local = [f.name for f in events.schema if f.dataType.typeName() == "timestamp_ntz"]
    return events.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else events
