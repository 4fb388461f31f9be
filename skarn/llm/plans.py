"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.llm import code_docs, duplicates, packing, pii, tokens, vectors
from skarn.session import table

#: table, key column, column that tells the current row
VECTOR_TABLES = (("mem_vectors", "observation_id", "created_at"), ("doc_vectors", "section_id", "created_at"), ("kg_nodes", "node_id", None))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.stored_pairs(table(spark, d, "nodes")).select("id")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.stored_pairs(table(spark, d, "nodes"))


def p1_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs found in the source text and code fences of documents."""
    return code_docs.source_pairs(table(spark, d, "documents"), "doc_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of keys with cosine of at least 0.9, per vector table."""
    parts = []
    for name, key, updated in VECTOR_TABLES:
        index = vectors.build_index(vectors.usable(table(spark, d, name), key, updated=updated))
        pairs = vectors.named(index, vectors.similar_pairs(index, 0.9), "id_a", "id_b")
        parts.append(pairs.select(F.lit(name).alias("vec_table"), F.least("id_a", "id_b").alias("key_a"), F.greatest("id_a", "id_b").alias("key_b")))
    return reduce(DataFrame.unionByName, parts)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each usable vector with its class of equal vectors (the smallest key names it), the number of its copies and the
    number of other classes with a cosine of at least 0.9: no copy is expanded into pairs."""
    parts = []
    for name, key, updated in VECTOR_TABLES:
        members, links = vectors.linked_classes(vectors.usable(table(spark, d, name), key, updated=updated), 0.9)
        counted = vectors.links_of(links)
        parts.append(members.join(counted, "class_id", "left").select(F.lit(name).alias("vec_table"), F.col("vec_key").alias("key"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links")))
    return reduce(DataFrame.unionByName, parts)


def p2_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar keys of every usable vector, per vector table."""
    parts = []
    for name, key, updated in VECTOR_TABLES:
        rows = vectors.usable(table(spark, d, name), key, updated=updated)
        index = vectors.build_index(rows, cell_size=None)
        near = vectors.named(index, vectors.nearest(index, 10), "vec_id", "other")
        parts.append(near.select(F.lit(name).alias("vec_table"), F.col("vec_id").alias("key"), "rank", F.col("other").alias("neighbour"), F.round("cosine", 5).alias("cosine")))
    return reduce(DataFrame.unionByName, parts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.members(table(spark, d, "mem_observations"), "id", "content")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each set of equal records with its number of copies; repeated rows of an id count once."""
    return duplicates.classes(table(spark, d, "mem_observations"), "id", "content", distinct_ids=True)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose decoded ids aren't their text again: none."""
    docs = table(spark, d, "documents")
    back = tokens.decode_column(tokens.encode_column(docs, "doc_id", "text"), "ids", "back")
    return back.select("doc_id", "back").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").where("back <> text").select("doc_id")


def capacities(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The few container sizes are parameters, not data; more than a hundred are refused."""
    rows = table(spark, d, "pack_sizes").select("pack_name", "capacity_tokens").distinct().orderBy("pack_name").take(101)
    if len(rows) > 100:
        raise ValueError("too many container sizes")
    return [(r[0], r[1]) for r in rows]


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", capacities(spark, d))


def p9_waste(spark: SparkSession, d: str) -> DataFrame:
    """Containers and share of unused space per pack."""
    sizes = capacities(spark, d)
    packed = p9_pack(spark, d).groupBy("pack_name", "container").agg(F.sum("size").alias("used")).groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used"))
    cap = F.coalesce(*[F.when(F.col("pack_name") == n, F.lit(c)) for n, c in sizes]) if sizes else F.lit(1)
    return packed.withColumn("unused_share", F.round(1 - F.col("used") / (F.col("containers") * cap), 5))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_cases(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "name_lexicon"))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.mask(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "name_lexicon"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_pairs, p1_source_pairs, p2_found, p2_classes, p2_knn, p6_found, p6_classes, p8_ids, p8_round_trip, p9_pack, p9_waste, p10_found, p10_masked)
}


def _p2_sql(name: str, key: str, updated: str | None) -> str:
    return f"""
select '{name}' vec_table, a.k key_a, b.k key_b from {name}_u a join {name}_u b on a.k < b.k
where list_cosine_similarity(a.e, b.e) >= 0.9"""


def _p2_with(name: str, key: str, updated: str | None) -> str:
    order = updated or "0"
    return f"""{name}_u as (
  select k, list_transform(e, lambda x: x::double) e from (select {key} k, arg_max(struct_pack(e := embedding), {order}).e e from {name} where {key} is not null group by 1)
  where len(e) = 64 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0)"""


_P6_FIELD = duplicates.FIELD.replace("'", "''").replace("\\A", "^")
_P6_LETTERS = "replace(translate(lower(upper(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))), 'ς', 'σ'), 'ß', 'ss')"


def _letters(x: str) -> str:
    return _P6_LETTERS.format(x)


_P6 = f"""
with r as (select distinct id, content from mem_observations where id is not null and content is not null),
f as (select *, regexp_extract_all(content, '{_P6_FIELD}', 1) names, string_split_regex(content, '{_P6_FIELD}') vals, {_letters("content")} plain from r),
l as (select id, content, plain, case when len(names) >= 2 and {_letters("vals[1]")} = ''
  then chr(1) || array_to_string(list_sort(list_transform(range(1, len(names) + 1), lambda i: {_letters("names[i]")} || '=' || {_letters("vals[i + 1]")})), chr(2)) end listed from f),
c as (select id, content, coalesce(min(listed) over (partition by plain), plain) canonical from l),
k as (select *, min(id) over (partition by canonical) keep_id from c)
"""
ORACLES = {
    "p6_found": _P6 + "select distinct keep_id, id from k where id <> keep_id",
    "p6_classes": _P6 + "select keep_id, count(*) copies, count(distinct content) spellings from k group by canonical, keep_id",
    "p8_round_trip": "select doc_id from documents where false",
    "p2_found": "with " + ",".join(_p2_with(*t) for t in VECTOR_TABLES) + " union all ".join(_p2_sql(*t) for t in VECTOR_TABLES),
}
