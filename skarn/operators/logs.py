"""Logs: runs of similar lines, head and tail, budgets and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from skarn.skew import running_sum


def collapse(lines: DataFrame) -> DataFrame:
    """Marks lines (doc_id, line_no, line) that differ from the one before by more than numbers as the first of a run."""
    plain = F.regexp_replace("line", "[0-9]+", "#")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.lag("plain").over(w)
    return lines.withColumn("plain", plain).withColumn("first", before.isNull() | (before != F.col("plain"))).drop("plain")


def head_tail(lines: DataFrame, limit: int = 100) -> DataFrame:
    """Of each document's lines the first 60 % and last 40 % of ``limit``."""
    w = Window.partitionBy("doc_id")
    n = F.count(F.lit(1)).over(w)
    return lines.withColumn("n", n).where((F.col("n") <= limit) | (F.col("line_no") < int(limit * 0.6)) | (F.col("line_no") >= F.col("n") - int(limit * 0.4))).drop("n")


def savings(records: DataFrame) -> DataFrame:
    """Tokens before and after per command family (what precedes a colon)."""
    family = F.element_at(F.split("command", ":"), 1)
    g = records.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("commands"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed"))
    return g.withColumn("saved_percent", F.floor((1 - F.col("compressed") / F.col("original")) * 100 + 0.5))


def budget(records: DataFrame, limit: int = 100_000, warn: int = 80_000, throttle: int = 95_000) -> DataFrame:
    """Running consumption per session with its state; a session of very many records is cut into ranges."""
    return running_sum(records, "session_id", ["at", "id"], "tokens", "used").withColumn("state", F.when(F.col("used") >= throttle, "throttle").when(F.col("used") >= warn, "warn").otherwise("ok")).withColumn("utilisation", F.round(F.col("used") / limit, 4))


# Where savings come from; anything else counts as the first.
SOURCES = ("exec", "graph", "memory", "docs", "data")


def savings_by_source(records: DataFrame) -> DataFrame:
    """Number and saved tokens per source: (source, commands, saved)."""
    source = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise(SOURCES[0])
    return records.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("commands"), F.sum(F.col("original") - F.col("compressed")).alias("saved"))


def latest_savings(records: DataFrame, n: int = 10) -> DataFrame:
    """The last commands, newest first: (at, command, saved_percent); without tokens before nothing is saved."""
    saved = F.when(F.col("original") > 0, F.floor((F.col("original") - F.col("compressed")) * 100 / F.col("original") + 0.5)).otherwise(0)
    return records.orderBy(F.desc("at"), "command").limit(n).select("at", "command", saved.alias("saved_percent"))


def repeated_paging(calls: DataFrame, least: int = 5, within_ms: int = 60_000) -> DataFrame:
    """Readers that page through a dataset with ever greater offsets: (session_id, dataset_id, at) of each call that is the
    ``least`` + 1st or later of a run in which each call comes within ``within_ms`` of the run's first one."""
    w = Window.partitionBy("session_id", "dataset_id").orderBy("at", "offset")
    back = F.lag("at", least).over(w)
    rising = F.col("offset") > F.lag("offset").over(w)
    marked = calls.withColumn("back", back).withColumn("rising", rising.cast("int"))
    run = F.min("rising").over(w.rowsBetween(-least + 1, 0))
    return marked.withColumn("run", run).where((F.col("run") == 1) & (F.col("at") - F.col("back") <= within_ms)).select("session_id", "dataset_id", "at")


def within_budget(text, tokens: int, most: int = 15_000):
    """A text cut to a number of tokens of four characters, and to ``most`` characters in any case, with a mark."""
    limit = min(tokens * 4, most)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n… (truncated)"))).otherwise(text)


def rotated(records: DataFrame, most_bytes: int, order: str = "at", line: str = "line") -> DataFrame:
    """The newest records of a log whose lines together have at most ``most_bytes`` bytes: what a rotation keeps."""
    sized = records.withColumn("__all", F.lit(1)).withColumn("__size", -(F.octet_length(line).cast("bigint") + 1)).withColumn("__back", -F.col(order))
    kept = running_sum(sized, "__all", ["__back", line], "__size", "__used")
    return kept.where(F.col("__used") >= -most_bytes).drop("__all", "__size", "__back", "__used")


def over_threshold(counts: DataFrame, at: int, size: str = "n") -> DataFrame:
    """Keys whose pending work has reached a threshold, which starts their processing."""
    return counts.where(F.col(size) >= at)
