"""Full-text, vector and hybrid search over DataFrames: postings, BM25, cosine, tiers and rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

K1, B = 1.2, 0.75
# Words that a query leaves out.
STOP_WORDS = frozenset(
    "the and for with from this that have been will would could should does done make made use used using work works find found show call called get set add all any how what when where which who "
    "why fix bug code file files function method class type build run test a an in of to is it by on at as or be do if no so up not but are was has had its can may also into then than just more "
    "some such each over only new out two way see him his her she they them their our your you we me my".split()
)


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    """Words of a query: identifiers are split, words below three letters and stop words left out."""
    import re

    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", text))
    words = [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced)]
    return list(dict.fromkeys(w for w in words if len(w) >= 3 and w not in STOP_WORDS))


def match_terms(text: str) -> list[str]:
    """A full-text query without operators and punctuation; the last term is a prefix."""
    import re

    return [w for w in re.sub(r"[^\w\s]|\b(?:AND|OR|NOT)\b", " ", text).lower().split() if w]


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(term, doc, tf, length): one row per term and document; the counts are made before the shuffle."""
    t = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), tokens(F.col(text)).alias("ts"))
    return t.select("doc", F.size("ts").alias("length"), F.explode("ts").alias("term")).groupBy("term", "doc", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, id: str, text: str, query: str, n: int | None = None, prefix: bool = True) -> DataFrame:
    """(doc, score) of the documents with every term of the query; the last term matches as a prefix.

    The query's terms are filtered where the text is read, so only postings of these terms are shuffled. idf is
    ln(1 + (N - df + .5) / (df + .5)).
    """
    terms = match_terms(query)
    if not terms:
        return docs.sparkSession.createDataFrame([], "doc string, score double")
    base = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), tokens(F.col(text)).alias("ts"))
    hit = [(lambda t, last: lambda x: x.startswith(t) if last else x == t)(t, prefix and i == len(terms) - 1) for i, t in enumerate(terms)]
    tf = [F.size(F.filter("ts", h)) for h in hit]
    rows = base.select("doc", F.size("ts").alias("length"), *[x.alias(f"tf{i}") for i, x in enumerate(tf)])
    rows = rows.where(" and ".join(f"tf{i} > 0" for i in range(len(terms))))
    counted = [F.count_if(x > 0).alias(f"df{i}") for i, x in enumerate(tf)]
    corpus = base.agg(F.struct(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("ts")).alias("mean_length"), *counted).alias("s")).scalar()
    scored = rows.withColumn("s", corpus).select("*", "s.*")
    parts = [
        F.ln(1 + (F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1)
        / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
        for i in range(len(terms))
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    out = scored.select("doc", F.round(total, 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc").limit(n) if n else out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 when a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, F.nullif(norm(a) * norm(b), F.lit(0.0))), F.lit(0.0))


def nearest(vectors: DataFrame, id: str, vector: str, query: Sequence[float], n: int, floor: float | None = None) -> DataFrame:
    """Exact nearest vectors of one query vector: (id, score); a top-k per partition and a merge."""
    q = F.array(*[F.lit(float(v)) for v in query])
    scored = vectors.where(F.size(vector) == len(query)).select(F.col(id).alias("id"), F.round(cosine(F.col(vector), q), 6).alias("score"))
    scored = scored if floor is None else scored.where(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), "id").limit(n)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, alpha: float = 0.5, normalise: bool = True) -> DataFrame:
    """(id, score) from (id, fts) and (id, vec): alpha weighs the vectors; a text score is divided by the greatest, or by
    one if that is less; what only one side has counts zero on the other."""
    top = F.greatest(F.coalesce(F.max("fts"), F.lit(1.0)), F.lit(1.0)) if normalise else F.lit(1.0)
    j = text_hits.join(vector_hits, "id", "full_outer").withColumn("top", text_hits.agg(top.alias("top")).scalar())
    return j.select("id", F.round((1 - alpha) * F.coalesce("fts", F.lit(0.0)) / F.col("top") + alpha * F.coalesce("vec", F.lit(0.0)), 4).alias("score"))


def memory_hybrid(text_hits: DataFrame, vector_hits: DataFrame, alpha: float = 0.5, floor: float | None = None, relations: DataFrame | None = None) -> DataFrame:
    """(id, score) like :func:`hybrid`, but where only one side has hits, its own scores stand. floor: least vector score.
    relations (a, b, relation) are attached to their ends as (id, score, relations), in order."""
    vec = vector_hits if floor is None else vector_hits.where(F.col("vec") >= floor)
    some = lambda df: F.coalesce(df.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(0)) > 0
    both = hybrid(text_hits, vec, alpha).withColumnRenamed("score", "mixed")
    raw = text_hits.select("id", F.col("fts").alias("own")).unionByName(vec.select("id", F.col("vec").alias("own"))).groupBy("id").agg(F.max("own").alias("own"))
    out = both.join(raw, "id").withColumn("two", some(text_hits) & some(vec)).select("id", F.when(F.col("two"), F.col("mixed")).otherwise(F.round("own", 4)).alias("score"))
    if relations is None:
        return out
    ends = relations.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), "relation"), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), "relation"))).alias("r")).select("r.*")
    listed = ends.join(out.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "relation", "other"))).alias("relations"))
    return out.join(listed, "id", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))


def symbol_tiers(nodes: DataFrame, text: str) -> DataFrame:
    """Symbols by exact name, else by words of the name with the last as a prefix, else by part of the name; the best
    tier with a hit counts: (id, tier). One pass: each row gets its own best tier, the least over all is kept."""
    from skarn.functions.text import split_camel

    terms = query_terms(text) or [text.lower()]
    words = split_camel(F.col("name"))
    has = F.lit(True)
    for i, t in enumerate(terms):
        has = has & (F.exists(words, (lambda t: lambda w: w.startswith(t))(t)) if i == len(terms) - 1 else F.array_contains(words, t))
    tier = F.when(F.col("name") == text, 1).when(has, 2).when(F.lower("name").contains(text.lower()), 3)
    hits = nodes.select("id", tier.alias("tier")).where("tier is not null").distinct()
    return hits.join(F.broadcast(hits.agg(F.min("tier").alias("tier"))), "tier").select("id", "tier")


def path_relevance(path: Column, terms: Sequence[str]) -> Column:
    """+10 for a term that is the file's name without its extension, +5 for one that is a folder, +3 for one within either."""
    parts = F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda p: p != "")
    name, total = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(.)\.[^.]*$", "$1"), F.lit(0)
    for t in terms:
        folder, within = (lambda t: (lambda p: p == t, lambda p: p.contains(t)))(t)
        total = total + F.when(name == t, 10).when(F.exists(F.slice(parts, 1, F.size(parts) - 1), folder), 5).when(F.exists(parts, within), 3).otherwise(0)
    return total


# Bonus of a symbol's kind in rankings.
KIND_BONUS = {
    "function": 10, "method": 10, "route": 9, "class": 8, "component": 8, "interface": 7, "type_alias": 6, "struct": 6, "trait": 6, "enum": 5, "module": 4, "namespace": 4,
    "property": 3, "field": 3, "constant": 3, "variable": 2, "import": 1, "export": 1,
}


def kind_bonus(kind: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, kind), F.lit(0))


#: Kinds of symbols that get an embedding.
EMBEDDABLE_KINDS = ("function", "method", "class", "interface", "type_alias", "component", "module")


def embedding_text(limit: int = 2000) -> Column:
    """Text of a symbol that an embedding is made of."""
    return F.substring(F.concat_ws("\n", F.concat_ws(" ", "kind", "name"), "qualified_name", "file_path", "signature", "docstring"), 1, limit)


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Stand-in for an embedding: signed feature hashing of the words, as an array of ``dim`` numbers. The words are hashed in
    the JVM; their signs are added up by slot in Arrow batches, in time linear in their number. Null for a null text."""
    ts = tokens(text)

    @F.pandas_udf("array<double>")
    def fold(slots, signs):
        import numpy as np

        return slots.combine(signs, lambda i, s: None if i is None else np.bincount(i, weights=s, minlength=dim) if len(i) else np.zeros(dim))

    return fold(F.transform(ts, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")), F.transform(ts, lambda t: F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0)))


def task_context(nodes: DataFrame, text: str, n: int = 20) -> DataFrame:
    """Symbols for a task: exact names, then words of the name, then of the docstring; imports and exports left out."""
    terms = query_terms(text)
    arr = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    from skarn.functions.text import split_camel

    words = F.size(F.array_intersect(split_camel(F.col("name")), arr))
    told = F.size(F.array_intersect(tokens(F.coalesce("docstring", F.lit(""))), arr))
    rated = nodes.where(~F.col("kind").isin("import", "export")).select("id", F.when(F.lower("name").isin(terms), 1).when(words > 0, 2).when(told > 0, 3).alias("tier"), words.alias("words"), told.alias("told"), kind_bonus(F.col("kind")).alias("bonus"))
    return rated.where("tier is not null").distinct().orderBy("tier", F.desc("words"), F.desc("told"), F.desc("bonus"), "id").limit(n)
