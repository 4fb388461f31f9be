"""Records that are identical but for white space, letter case, punctuation or the order of named fields.

Byte-identical contents are collapsed first, with counts; only the distinct survivors are put into canonical form; a
second aggregate over the full canonical text sums the counts. Everything is expressed in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skarn.session import cut
from skarn.skew import HOT_SHARE, salted_join

_WHITE = r"[\s\p{Z}]"
_QUOTE = r"[\"'“”«»‘’„*`]"
#: Where a named field begins: at the start or behind a separator, then the name, then a colon or an equals sign.
FIELD = (
    rf"(?:\A|[;|,\n\r{{]|{_WHITE}[-*•–—+]{_WHITE})[\s\p{{Z}}\"'“”«»‘’„*`{{\[(#>•–—+-]*"
    rf"([\p{{L}}_][\p{{L}}\p{{M}}\p{{N}}_.-]*){_QUOTE}*{_WHITE}*[:=]{_QUOTE}*{_WHITE}*"
)
PLAIN = r"[^\p{L}\p{N}]+"


def letters(c: Column) -> Column:
    """Letters and digits in order, in one letter case; ß counts as the SS it becomes in capitals."""
    return F.replace(F.translate(F.lower(F.upper(F.regexp_replace(c, PLAIN, ""))), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def fields(c: Column) -> Column:
    """Sorted ``name=value`` texts of a list of at least two named fields, in letters and digits; null for other texts."""
    names = F.regexp_extract_all(c, F.lit(FIELD), F.lit(1))
    values = F.split(c, FIELD)
    pairs = F.array_sort(F.zip_with(names, F.slice(values, 2, F.size(names)), lambda n, v: F.concat(letters(n), F.lit("="), letters(v))))
    is_list = (F.size(names) >= 2) & (F.size(values) == F.size(names) + 1) & (letters(F.element_at(values, 1)) == "")
    return F.when(is_list, F.concat(F.lit("\u0001"), F.array_join(pairs, "\u0002")))


def digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def survivors(df: DataFrame, id: str, content: str) -> DataFrame:
    """Distinct contents with smallest and greatest id, the number of rows, and the canonical text.

    A text that spells the same letters as a list of fields belongs to that list's set, so that the two kinds of
    equality act together: texts with equal letters take the fields of the least list among them.
    """
    rows = df.select(F.col(id).alias("id"), F.col(content).alias("content")).where("id is not null and content is not null")
    raw = rows.groupBy("content").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("copies"))
    return raw.select(digest(F.col("content")).alias("raw"), letters(F.col("content")).alias("plain"), fields(F.col("content")).alias("listed"), "low", "high", "copies")


def classes(df: DataFrame, id: str, content: str, distinct_ids: bool = False) -> DataFrame:
    """One row per set of equal records: (keep_id, copies, spellings). ``copies`` counts rows, or distinct ids of each
    content: these are counted beside the content's digest, so that a text is never shuffled with its ids."""
    distinct = survivors(df, id, content)
    if distinct_ids:
        once = df.select(F.col(id).alias("id"), digest(F.col(content)).alias("raw")).where("id is not null and raw is not null").distinct()
        distinct = distinct.drop("copies").join(once.groupBy("raw").agg(F.count(F.lit(1)).alias("copies")), "raw")
    return _by_text(distinct).groupBy("canonical").agg(
        F.min("low").alias("keep_id"), F.sum("copies").alias("copies"), F.sum("spellings").alias("spellings")
    ).select("keep_id", "copies", "spellings")


def _by_text(distinct: DataFrame) -> DataFrame:
    by = distinct.groupBy("plain").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("spellings"), F.min("listed").alias("listed")
    )
    return by.withColumn("canonical", F.coalesce("listed", "plain"))


def members(df: DataFrame, id: str, content: str) -> DataFrame:
    """(keep_id, id) for every other id of each set of equal records; keep_id is the smallest id of the set.

    Defined cases: null ids and null contents don't take part; contents without any letter or digit are equal to each
    other; repeated rows count once; other columns are ignored. A set of any size is written as its members, never as
    pairs, and the rows of a content with very many copies are spread over tasks.
    """
    # Written once: the distinct contents are read three times below, the raw rows only once more, at the end.
    distinct = cut(survivors(df, id, content), "survivors")
    texts = _by_text(distinct)
    keep = texts.groupBy("canonical").agg(F.min("low").alias("keep_id"), F.max("high").alias("last")).where("keep_id < last").drop("last")
    # The canonical text leads from the kept record to spellings, the spelling's digest to the rows.
    of_text = texts.select("canonical", digest(F.col("plain")).alias("text")).join(keep, "canonical").select("text", "keep_id")
    # Very many spellings may have one text (all those without a letter or digit have): it is spread, too.
    spelled = salted_join(distinct.select("raw", digest(F.col("plain")).alias("text")), of_text, "text", "inner").select("raw", "keep_id")
    rows = df.select(F.col(id).alias("id"), digest(F.col(content)).alias("raw")).where("id is not null and raw is not null")
    # The counts of the first collapse tell which contents are hot: at most 1 / HOT_SHARE of them.
    least = distinct.agg((F.sum("copies") * F.lit(HOT_SHARE)).alias("least")).scalar()
    hot = distinct.where(F.col("copies") >= least).select(F.col("raw").alias("hot_key"))
    return salted_join(rows, spelled, "raw", "inner", hot=hot).where("id <> keep_id").select("keep_id", "id").distinct()
