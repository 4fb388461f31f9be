"""Observations as a time-stamped log: as-of views, timelines, links, reviews, capture and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from skarn.skew import carried, salted_join


def as_of(obs: DataFrame, at: int) -> DataFrame:
    """Observations valid at a time: open ends count, superseded ones don't."""
    return obs.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)) & F.col("superseded_by").isNull())


def time_range(obs: DataFrame, start: int, stop: int) -> DataFrame:
    return obs.where(F.col("created_at").between(start, stop))


def timeline(obs: DataFrame, per_session: int = 10) -> DataFrame:
    """The latest observations of each session; the limit is pushed below the sort of the window."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "id")
    return obs.where("session_id is not null").dropDuplicates(["id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_session)


def links_for(links: DataFrame) -> DataFrame:
    """Observations per symbol with their greatest relevance, and the latest time among equal ones."""
    best = F.max(F.struct("relevance", "created_at"))
    return links.where("qualified_name is not null").groupBy("qualified_name", "observation_id").agg(best.alias("b")).select("qualified_name", "observation_id", "b.relevance", "b.created_at")


def store(obs: DataFrame) -> DataFrame:
    """One observation per content: the earliest row of each content hash (computed where it is absent)."""
    hashed = obs.where("content is not null").withColumn("hash", F.coalesce("content_hash", F.sha2("content", 256)))
    return hashed.groupBy("hash").agg(F.min(F.struct("created_at", "id")).alias("m"), F.count(F.lit(1)).alias("stored")).select("hash", "m.id", "m.created_at", "stored")


def pending(obs: DataFrame, summary_kind: str = "summary") -> DataFrame:
    """Per session the observations after its last summary."""
    last = obs.groupBy("session_id").agg(F.max(F.when(F.col("kind") == summary_kind, F.col("created_at"))).alias("since"))
    j = obs.where(F.col("kind") != summary_kind).join(last, "session_id").where("since is null or created_at > since")
    return j.groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"))


def review_due(obs: DataFrame, now: int) -> DataFrame:
    return obs.where((F.col("review_after") < now) & F.col("superseded_by").isNull())


def topic_key(kind, content, words: int = 6):
    """``kind/slug`` of the first words."""
    from skarn.functions.text import slug

    first = F.array_join(F.slice(F.filter(F.split(content, r"[\s]+"), lambda w: w != ""), 1, words), " ")
    return F.concat(F.lower(kind), F.lit("/"), slug(first))


def relation_pairs(relations: DataFrame) -> DataFrame:
    """One judged relation per unordered pair: the latest."""
    p = relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "relation", "confidence", "created_at")
    return p.groupBy("a", "b").agg(F.max(F.struct("created_at", "confidence", "relation")).alias("m")).select("a", "b", "m.relation", "m.confidence")


def capture(lines: DataFrame, kinds: dict[str, str], least: int = 5) -> DataFrame:
    """Bullets below known headings: (doc_id, kind, bullet). The heading above is found within each document's lines."""
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*$", 1)
    known = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k.lower(), v)])
    marked = lines.withColumn("kind", F.when(heading != "", F.coalesce(F.try_element_at(known, F.lower(heading)), F.lit(""))))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumn("kind", F.last("kind", ignorenulls=True).over(w))
    bullet = F.trim(F.regexp_extract("line", r"^\s*[-*]\s+(.*)$", 1))
    return carried.where(F.col("kind").isNotNull() & (F.col("kind") != "")).withColumn("bullet", bullet).where(F.length("bullet") >= least).select("doc_id", "line_no", "kind", "bullet")


def stale_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links to names without a node."""
    return links.where("qualified_name is not null").join(nodes.select("qualified_name").distinct(), "qualified_name", "left_anti")


def prune(obs: DataFrame, before: int) -> DataFrame:
    """Observations that stay when those older than a time and superseded are removed."""
    return obs.where((F.col("created_at") >= before) | F.col("superseded_by").isNull())


def duration_ms(text: str, default: str = "90d") -> int:
    """Nh, Nd, Nw or Nm in milliseconds."""
    import re

    m = re.fullmatch(r"(\d+)\s*([hdwm])", (text or default).strip().lower()) or re.fullmatch(r"(\d+)([hdwm])", default)
    return int(m[1]) * {"h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "m": 2_592_000_000}[m[2]]


def successive(obs: DataFrame, kind: str | None = "decision") -> DataFrame:
    """Candidates for conflicts: each observation of a kind with the one before it in its topic: (topic_key, earlier, later).

    Neighbours in time only, so a topic of any size adds one pair per observation; no kind takes all observations. A topic
    with a great share of them is cut into ranges of time.
    """
    wanted = obs.where(F.col("topic_key").isNotNull() & F.col("id").isNotNull())
    own = (wanted if kind is None else wanted.where(F.col("kind") == kind)).select("topic_key", "id", "created_at").distinct()
    return carried(own, "topic_key", ["created_at", "id"], "id", "earlier", inclusive=False).where("earlier is not null").select("topic_key", "earlier", F.col("id").alias("later"))


def without_private(c):
    """Text without what stands between private marks."""
    return F.regexp_replace(c, r"(?is)<private>.*?</private>", "[private]")


def close_stale(sessions: DataFrame, now: int, after_ms: int = 7_200_000) -> DataFrame:
    """Open sessions (session_id, started_at, ended_at) that began too long ago get an end."""
    stale = F.col("ended_at").isNull() & (F.col("started_at") < now - after_ms)
    return sessions.withColumn("ended_at", F.when(stale, F.lit(now)).otherwise(F.col("ended_at")))


def as_of_search(obs: DataFrame, at: int, query: str, n: int | None = None) -> DataFrame:
    """Observations valid at a time that match a query, by BM25 over these: (doc, score)."""
    from skarn.operators.search import bm25

    return bm25(as_of(obs, at).select("id", "content").distinct(), "id", "content", query, n)


def conflict_scan(obs: DataFrame, relations: DataFrame | None = None, words: int = 8, least: float = 0.3) -> DataFrame:
    """Pairs of observations one of which holds what the other begins with: (a, b, similarity), a < b.

    An observation of at least 20 characters asks for its first ``words`` words; one matches that holds them all (in
    lower case, each word as often as it likes). similarity is the share of the matching text's distinct words that were
    asked for, and has to exceed ``least``; related pairs (a, b) are left out. Equal texts count once, under their
    smallest id. A question is joined to the texts by its rarest word only, and the others are checked on the row, so a
    word that very many texts hold is a key only where all words of a question are that frequent.
    """
    from skarn.operators.search import tokens

    texts = obs.where(F.length("content") >= 20).groupBy("content").agg(F.min("id").alias("id")).where("id is not null")
    t = texts.select("id", F.array_distinct(tokens(F.col("content"))).alias("ts"), F.array_distinct(F.slice(tokens(F.col("content")), 1, words)).alias("ask")).where(F.size("ask") > 0)
    df = t.select(F.explode("ts").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = salted_join(t.select("id", "ask", F.explode("ask").alias("term")), df, "term", "inner")
    rare = asked.groupBy("id").agg(F.min(F.struct("df", "term")).alias("r"), F.max("ask").alias("ask")).select("id", "ask", F.col("r.term").alias("term"))
    # Only texts that can be similar enough: a question has at most ``words`` words.
    can = t.where(F.size("ts") * least < words)
    hits = rare.withColumnsRenamed({"id": "asker"}).join(can.select("id", "ts", F.explode("ts").alias("term")), "term")
    share = F.size("ask") / F.size("ts")
    pairs = hits.where((F.col("asker") != F.col("id")) & (share > least) & (F.size(F.array_except("ask", "ts")) == 0))
    out = pairs.groupBy(F.least("asker", "id").alias("a"), F.greatest("asker", "id").alias("b")).agg(F.max(F.round(share, 4)).alias("similarity"))
    if relations is None:
        return out
    return out.join(relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


# Kinds of symbols that texts may name.
NAMED_KINDS = ("function", "method", "class", "interface", "type_alias", "component", "variable")
_NAMES = r"(?<![A-Za-z0-9_])([A-Z]?[a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:_[a-z]+)+|[A-Z]+(?:_[A-Z]+)+)(?![A-Za-z0-9_])"


def symbols_named(obs: DataFrame, nodes: DataFrame, id: str = "id", text: str = "content") -> DataFrame:
    """Symbols that texts name: (id, name, qualified_name). Identifiers of several words are looked up by name; of several
    symbols of one name an exported one counts, then the smallest qualified name. One row per name is joined."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(_NAMES), F.lit(1)))
    asked = obs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.explode(names).alias("name")).distinct()
    best = F.min(F.struct((~F.coalesce("is_exported", F.lit(False))).alias("hidden"), "qualified_name"))
    side = nodes.where(F.col("kind").isin(*NAMED_KINDS) & F.col("name").isNotNull() & F.col("qualified_name").isNotNull()).groupBy("name").agg(best.alias("m"))
    return salted_join(asked, side, "name", "inner").select("id", "name", F.col("m.qualified_name").alias("qualified_name"))
