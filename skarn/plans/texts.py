"""Queries of search, documents, memory, name resolution and text functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.functions import text as T
from skarn.operators import documents, memory, resolve, search
from skarn.session import table

Q: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BM = """with d as (select {id} doc, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') ts from {t} where {text} is not null),
s as (select count(*) n, avg(len(ts)) m from d), h as (select doc, len(ts) l, len(list_filter(ts, lambda t: t = '{a}')) a, len(list_filter(ts, lambda t: starts_with(t, '{b}'))) b from d),
f as (select count(*) filter (where a > 0) fa, count(*) filter (where b > 0) fb from h)
select doc, round(ln(1 + (n - fa + .5) / (fa + .5)) * a * 2.2 / (a + 1.2 * (.25 + .75 * l / m)) + ln(1 + (n - fb + .5) / (fb + .5)) * b * 2.2 / (b + 1.2 * (.25 + .75 * l / m)), 6) score
from h, s, f where a > 0 and b > 0"""


@query(_BM.format(id="doc_id", text="text", t="documents", a="index", b="snap"))
def x_bm25(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", "index snap")


@query(_BM.format(id="id", text="content", t="(select distinct id, content from mem_observations)", a="cursor", b="clos"))
def x_bm25_memory(spark, d):
    return search.bm25(table(spark, d, "mem_observations").select("id", "content").distinct(), "id", "content", "cursor AND clos*")


@query("""with d as (select doc_id doc, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') ts from documents where text is not null)
select term, count(*) docs, sum(tf)::bigint occurrences from (select doc, unnest(ts) term, 1 tf from d) group by term, doc having true""".replace("select term, count(*) docs, sum(tf)::bigint occurrences from (select doc, unnest(ts) term, 1 tf from d) group by term, doc having true", "select term, count(distinct doc) docs, count(*) occurrences from (select doc, unnest(ts) term from d) group by term"))
def x_postings(spark, d):
    p = search.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"select distinct id, {_WORDS}::varchar words from nodes where name is not null")
def x_tokeniser(spark, d):
    return table(spark, d, "nodes").where("name is not null").select("id", F.concat(F.lit("["), F.array_join(T.split_camel(F.col("name")), ", "), F.lit("]")).alias("words")).distinct()


@query(f"""with w as (select distinct id, name, {_WORDS} ws from nodes), t as (select id, case when name = 'fetch cache' then 1 when list_contains(ws, 'fetch') and len(list_filter(ws, lambda x: starts_with(x, 'cache'))) > 0 then 2
when contains(lower(name), 'fetch cache') then 3 end tier from w) select distinct id, tier from t where tier = (select min(tier) from t)""")
def x_symbol_search(spark, d):
    return search.symbol_tiers(table(spark, d, "nodes"), "fetch cache")


_ONE_PATH = """case when regexp_replace(string_split(lower(file_path), '/')[-1], '(.)[.][^.]*$', '\\1') = '{t}' then 10 when list_contains(string_split(lower(file_path), '/')[:-2], '{t}') then 5
when len(list_filter(string_split(lower(file_path), '/'), lambda x: contains(x, '{t}'))) > 0 then 3 else 0 end"""
_PATH = " + ".join(_ONE_PATH.format(t=t) for t in ("parser", "auth"))


@query(f"select distinct file_path, {_PATH} score from nodes where file_path is not null")
def x_path_relevance(spark, d):
    return table(spark, d, "nodes").where("file_path is not null").select("file_path", search.path_relevance(F.col("file_path"), ["parser", "auth"]).alias("score")).distinct()


@query("select kind, count(*) n, max(case when kind in ('function', 'method') then 10 when kind = 'route' then 9 when kind in ('class', 'component') then 8 when kind = 'interface' then 7 when kind in ('type_alias', 'struct', 'trait') then 6 when kind = 'enum' then 5 when kind in ('module', 'namespace') then 4 when kind in ('property', 'field', 'constant') then 3 when kind = 'variable' then 2 when kind in ('import', 'export') then 1 else 0 end) bonus from nodes group by 1")
def x_kind_bonus(spark, d):
    return table(spark, d, "nodes").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(search.kind_bonus(F.col("kind"))).alias("bonus"))


_VEC = "select vec_id id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) score from embeddings"


def _query_vector(spark, d):
    """The vector that asks; without it a zero vector, which is like none."""
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return row[0] if row else [0.0] * 64


@query(f"with s as ({_VEC}) select * from s where score >= 0.05")
def x_cosine(spark, d):
    q = F.array(*[F.lit(float(v)) for v in _query_vector(spark, d)])
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(search.cosine(F.col("embedding"), q), 6).alias("score")).where("score >= 0.05")


@query(f"with s as ({_VEC}) select * from s order by score desc, id limit 25")
def x_knn(spark, d):
    return search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 25)


@query(f"with s as ({_VEC}) select * from s where score >= 0.3 order by score desc, id limit 25")
def x_knn_floor(spark, d):
    return search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 25, 0.3)


_HYBRID = "with b as (" + _BM.format(id="doc_id", text="text", t="documents", a="index", b="snap") + f"), v as (select id, score vec from ({_VEC}) order by score desc, id limit 100), j as (select coalesce(b.doc, v.id) id, coalesce(b.score, 0) fts, coalesce(vec, 0) vec from b full join v on b.doc = v.id)"


@query(_HYBRID + " select id, round(.5 * fts / greatest((select max(score) from b), 1.0) + .5 * vec, 4) score from j")
def x_hybrid_normalised(spark, d):
    b = search.bm25(table(spark, d, "documents"), "doc_id", "text", "index snap").toDF("id", "fts")
    v = search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 100).toDF("id", "vec")
    return search.hybrid(b, v)


@query(_HYBRID + " select id, round(.5 * fts + .5 * vec, 4) score from j")
def x_hybrid_raw(spark, d):
    b = search.bm25(table(spark, d, "documents"), "doc_id", "text", "index snap").toDF("id", "fts")
    v = search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 100).toDF("id", "vec")
    return search.hybrid(b, v, normalise=False)


@query(_HYBRID + " select id, round(.3 * fts / greatest((select max(score) from b), 1.0) + .7 * vec, 4) score from j")
def x_hybrid_weighted(spark, d):
    b = search.bm25(table(spark, d, "documents"), "doc_id", "text", "index snap").toDF("id", "fts")
    v = search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 100).toDF("id", "vec")
    return search.hybrid(b, v, alpha=0.7)


@query(f"""with w as (select distinct id, kind, lower(name) as name, list_distinct({_WORDS}) ws, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(docstring, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) ds from nodes where kind not in ('import', 'export')),
q as (select *, ['fetch', 'cache', 'resolve', 'stale', 'snapshots'] ts from w), r as (select id, case when list_contains(ts, name) then 1 when len(list_intersect(ws, ts)) > 0 then 2 when len(list_intersect(ds, ts)) > 0 then 3 end tier, coalesce(len(list_intersect(ws, ts)), 0)::int words, len(list_intersect(ds, ts))::int told,
case when kind in ('function', 'method') then 10 when kind = 'route' then 9 when kind in ('class', 'component') then 8 when kind = 'interface' then 7 when kind in ('type_alias', 'struct', 'trait') then 6 when kind = 'enum' then 5 when kind in ('module', 'namespace') then 4 when kind in ('property', 'field', 'constant') then 3 when kind = 'variable' then 2 else 0 end bonus from q)
select distinct * from r where tier is not null order by tier, words desc, told desc, bonus desc, id limit 20""")
def x_task_context(spark, d):
    return search.task_context(table(spark, d, "nodes"), "How does the fetch cache resolve stale snapshots")


@query("select distinct id, substr(concat_ws(chr(10), concat_ws(' ', kind, name), qualified_name, file_path, signature, docstring), 1, 2000) text from nodes where id is not null and length(concat_ws('', kind, name)) > 0 and kind in ('function', 'method', 'class', 'interface', 'type_alias', 'component', 'module')")
def x_embedding_text(spark, d):
    return table(spark, d, "nodes").where(F.col("kind").isin(*search.EMBEDDABLE_KINDS) & F.col("id").isNotNull()).select("id", search.embedding_text().alias("text")).distinct()


@query()
def x_embedding_hashed(spark, d):
    return table(spark, d, "nodes").where(F.col("kind").isin(*search.EMBEDDABLE_KINDS)).select("id", search.hashed_vector(search.embedding_text()).alias("vector"))


# -- resolution -----------------------------------------------------------------------------------------------------
_NAMES = "w as (select distinct trim(qualified_name) ref_name from doc_code_refs where qualified_name is not null)"
_RESOLVE = f"""with {_NAMES},
c as (select ref_name, id node_id, 'qualified' strategy, 0.95 score, 1 r from w join nodes on qualified_name = ref_name where id is not null
union all select ref_name, id, 'suffix', 0.85, 2 from w join nodes on name = regexp_split_to_array(ref_name, '\\.|::')[-1] where regexp_matches(ref_name, '\\.|::') and id is not null
union all select ref_name, id, 'exact', 0.9, 3 from w join nodes on name = ref_name where id is not null union all select ref_name, id, 'lower', 0.5, 4 from w join nodes on lower(name) = lower(ref_name) where id is not null)
"""


@query(_RESOLVE + "select ref_name, arg_min(node_id, (r, node_id)) node_id, arg_min(strategy, (r, node_id)) strategy, arg_min(score, (r, node_id))::double score from c group by 1")
def r_resolve(spark, d):
    refs = table(spark, d, "doc_code_refs").select(F.trim("qualified_name").alias("ref_name"))
    return resolve.resolve_names(refs, table(spark, d, "nodes"))


@query("select distinct ref_name from (select trim(qualified_name) ref_name from doc_code_refs where qualified_name is not null) where ref_name not in (select ref_name from (" + _RESOLVE.replace("with ", "with ", 1) + "select distinct ref_name from c))")
def r_unresolved(spark, d):
    refs = table(spark, d, "doc_code_refs").where("qualified_name is not null").select(F.trim("qualified_name").alias("ref_name")).distinct()
    return refs.join(resolve.resolve_names(refs, table(spark, d, "nodes")), "ref_name", "left_anti")


@query("with n as (select distinct name from nodes where name is not null), w as (select distinct string_split(name, '.')[1] ref_name from n) select ref_name, arg_min(id, (kind not in ('class', 'interface', 'trait', 'protocol', 'struct'), id)) node_id from w join nodes on name = ref_name group by 1")
def r_types(spark, d):
    n = table(spark, d, "nodes")
    return resolve.resolve_types(n.where("name is not null").select(F.element_at(F.split("name", r"\."), 1).alias("ref_name")), n)


@query("""with i as (select distinct file_path from_file, replace(name, 'import:', '') spec from nodes where kind = 'import' and file_path is not null), c as (select from_file, spec, regexp_replace(from_file, '/[^/]*$', '') || '/' || substr(spec, 3) base from i where starts_with(spec, './')),
f as (select distinct file_path from nodes), s as (select unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '.py', '/__init__.py']) x, unnest(range(10)) r)
select from_file, spec, arg_min(base || x, r) to_file from c, s where base || x in (select file_path from f) group by all""")
def r_imports(spark, d):
    n = table(spark, d, "nodes")
    i = n.where("kind = 'import' and file_path is not null").select(F.col("file_path").alias("from_file"), F.regexp_replace("name", "import:", "").alias("spec"))
    return resolve.resolve_imports(i, n)


@query("""with p as (select id, string_split(qualified_name, '.') q from nodes where kind in ('class', 'interface', 'trait', 'module', 'namespace') and qualified_name is not null)
select prefix, min(id) node_id from (select id, unnest(list_transform(range(1, len(q) + 1), lambda i: array_to_string(q[1:i], '.'))) prefix from p) group by 1""")
def r_namespaces(spark, d):
    return resolve.namespace_prefixes(table(spark, d, "nodes"))


@query("with w as (select distinct name ref_name from nodes where name is not null) select ref_name, round(1 / count(distinct id), 6) confidence from w join nodes on name = ref_name group by 1")
def r_ambiguity(spark, d):
    n = table(spark, d, "nodes")
    return resolve.ambiguity(n.where("name is not null").select(F.col("name").alias("ref_name")), n)


# -- documents and wiki ---------------------------------------------------------------------------------------------
@query("with c as (select id, arg_max(struct_pack(f := file_path, p := position, l := level, t := title), updated_at) s from doc_sections where id is not null group by 1) select s.f file_path, s.p as position, repeat('  ', greatest(s.l - 1, 0)) || s.t entry from c")
def d_toc(spark, d):
    from skarn.skew import current_rows

    return documents.toc(current_rows(table(spark, d, "doc_sections").select("id", "file_path", "position", "level", "title", "updated_at"), ["id"], "updated_at"))


@query()
def d_markdown(spark, d):
    return documents.markdown_sections(table(spark, d, "documents"), "doc_id", "text")


@query("select section_id, qualified_name, ref_type, arg_max(confidence, (confidence, created_at)) confidence from doc_code_refs where section_id is not null and qualified_name is not null group by all")
def d_refs(spark, d):
    return documents.refs_by_section(table(spark, d, "doc_code_refs"))


@query("""with t as (select doc_id doc, list_transform(regexp_extract_all(text, '`([^`\\n]+)`', 1), lambda x: regexp_replace(x, '\\(.*\\)$', '')) a,
regexp_extract_all(text, '\\b((?:[a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]*)+)|(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)|(?:[a-z][a-z0-9]*(?:_[a-z0-9]+)+)|(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+))\\b', 1) b from documents where text is not null)
select distinct doc, name from (select doc, unnest(list_concat(a, b)) as name from t) where length(name) >= 3""")
def d_candidates(spark, d):
    return documents.candidate_references(table(spark, d, "documents"), "doc_id", "text")


@query("""with t as (select doc_id doc, list_transform(regexp_extract_all(text, '`([^`\\n]+)`', 1), lambda x: regexp_replace(x, '\\(.*\\)$', '')) a,
regexp_extract_all(text, '\\b((?:[a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]*)+)|(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)|(?:[a-z][a-z0-9]*(?:_[a-z0-9]+)+)|(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+))\\b', 1) b from documents where text is not null),
c as (select distinct doc, n from (select doc, unnest(list_concat(a, b)) n from t) where length(n) >= 3), m as (select distinct unnest([name, string_split(name, '.')[-1]]) n, qualified_name from nodes where name is not null and qualified_name is not null)
select distinct doc, qualified_name, 0.8::double confidence from c join m using (n)""")
def d_resolve(spark, d):
    c = documents.candidate_references(table(spark, d, "documents"), "doc_id", "text")
    return documents.resolve_references(c, table(spark, d, "nodes"))


@query("select distinct title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug from doc_sections where title is not null")
def d_slug(spark, d):
    return table(spark, d, "doc_sections").where("title is not null").select("title", T.slug(F.col("title")).alias("slug")).distinct()


@query("with cur as (select id, nullif(arg_max(coalesce(parent_id, ''), updated_at), '') parent_id from doc_sections where id is not null group by id) select id, parent_id from cur where parent_id is not null and parent_id not in (select id from cur)")
def d_lint(spark, d):
    return documents.broken_parents(table(spark, d, "doc_sections"))


@query("with p as (select p_partkey k, 'page-' || p_partkey slug, 'see [[page-' || (p_partkey * 7) % (select ceil(count(*) * 1.5)::bigint from part) || ']] and [[Page-' || p_partkey // 2 || ']]' c from part), l as (select distinct slug, unnest(list_transform(regexp_extract_all(c, '\\[\\[([^\\]|#]+)', 1), lambda x: trim(lower(x)))) target from p) select slug, 'broken ' || target finding from l where target not in (select slug from p) union all select slug, 'orphan' from p where slug not in (select target from l where slug <> target)")
def w_lint(spark, d):
    """A page per part; links go to one and a half times as many pages, so that some are broken."""
    part = table(spark, d, "part")
    n = part.agg(F.ceil(F.count(F.lit(1)) * 1.5)).scalar()
    p = part.withColumn("n", n).selectExpr("concat('page-', p_partkey) slug", "concat('see [[page-', (p_partkey * 7) % n, ']] and [[Page-', p_partkey div 2, ']]') content")
    return documents.wiki_lint(p, "slug", "content")


@query("with o as (select p_partkey k, p_brand b, 1 n from part where p_partkey % 6 < 5), w as (select p_partkey k, upper(p_brand) b, 2 n from part where p_partkey % 6 >= 4) select coalesce(o.k, w.k) k, coalesce(w.b, o.b) b, (coalesce(o.n, 0) + coalesce(w.n, 0))::bigint n from o full join w using (k)")
def w_upsert(spark, d):
    """Of six parts, four are only stored, one is only new and one is both."""
    p = table(spark, d, "part")
    o = p.where("p_partkey % 6 < 5").selectExpr("p_partkey k", "p_brand b", "1L n")
    return documents.upsert(o, p.where("p_partkey % 6 >= 4").selectExpr("p_partkey k", "upper(p_brand) b", "2L n"), ["k"], "n")


# -- memory ---------------------------------------------------------------------------------------------------------
@query("select coalesce(content_hash, sha256(content)) hash, arg_min(id, (created_at, id)) id, min(created_at) created_at, count(*) stored from mem_observations where content is not null group by 1")
def t_store(spark, d):
    return memory.store(table(spark, d, "mem_observations"))


@query("select session_id, count(*) pending from mem_observations o where kind <> 'decision' and created_at > coalesce((select max(created_at) from mem_observations s where s.kind = 'decision' and s.session_id = o.session_id), -1) and session_id is not null group by 1")
def t_pending(spark, d):
    return memory.pending(table(spark, d, "mem_observations").where("session_id is not null"), "decision")


@query("select id, created_at from mem_observations where created_at between 1735689600000 and 1738368000000")
def t_time_range(spark, d):
    return memory.time_range(table(spark, d, "mem_observations"), 1735689600000, 1738368000000).select("id", "created_at")


@query("select session_id, id, k from (select session_id, id, row_number() over (partition by session_id order by created_at desc, id) k from (select distinct session_id, id, created_at from mem_observations where session_id is not null)) where k <= 3")
def t_timeline(spark, d):
    return memory.timeline(table(spark, d, "mem_observations"), 3).select("session_id", "id", F.col("rank").cast("bigint").alias("k"))


@query("select qualified_name, observation_id, max(relevance) relevance, arg_max(created_at, (coalesce(relevance, -1), created_at)) created_at from mem_links where qualified_name is not null group by all")
def t_links(spark, d):
    return memory.links_for(table(spark, d, "mem_links"))


@query("select id from mem_observations where review_after < 1740000000000 and superseded_by is null")
def t_review_due(spark, d):
    return memory.review_due(table(spark, d, "mem_observations"), 1740000000000).select("id")


@query("select id, created_at from mem_observations where created_at >= 1735689600000 or superseded_by is null")
def t_prune(spark, d):
    return memory.prune(table(spark, d, "mem_observations"), 1735689600000).select("id", "created_at")


@query("select observation_id, qualified_name from mem_links where qualified_name is not null and qualified_name not in (select qualified_name from nodes where qualified_name is not null)")
def t_stale_links(spark, d):
    return memory.stale_links(table(spark, d, "mem_links"), table(spark, d, "nodes")).select("observation_id", "qualified_name")


@query("select distinct id, lower(kind) || '/' || regexp_replace(regexp_replace(lower(array_to_string(list_filter(regexp_split_to_array(content, '[\\s]+'), lambda w: w <> '')[1:6], ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') topic from mem_observations where content is not null and kind is not null")
def t_topic_key(spark, d):
    return table(spark, d, "mem_observations").where("content is not null and kind is not null").select("id", memory.topic_key(F.col("kind"), F.col("content")).alias("topic")).distinct()


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10)))))::int line_no from documents where text is not null),
h as (select *, nullif(regexp_extract(line, '^#{1,6}\\s+(.*?)\\s*$', 1), '') head from l), m as (select *, case when head is not null then case lower(head) when 'limits' then 'constraint' when 'usage' then 'pattern' when 'storage' then 'decision' else '' end end k from h),
c as (select *, last_value(k ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) kind from m), b as (select doc_id, line_no, kind, trim(regexp_extract(line, '^\\s*[-*]\\s+(.*)$', 1), ' ') bullet from c where kind <> '') select doc_id, line_no, kind, bullet from b where length(bullet) >= 5""")
def t_capture(spark, d):
    return memory.capture(documents.lines_of(table(spark, d, "documents"), "doc_id", "text"), {"limits": "constraint", "usage": "pattern", "storage": "decision"})


@query("with o as (select distinct id, superseded_by from mem_observations) select superseded_by, count(*) n from o where superseded_by is not null group by 1")
def t_superseded(spark, d):
    return table(spark, d, "mem_observations").select("id", "superseded_by").distinct().where("superseded_by is not null").groupBy("superseded_by").agg(F.count(F.lit(1)).alias("n"))


@query("with r as (select l_orderkey a, l_partkey b, l_returnflag relation, l_discount confidence, l_linenumber created_at from lineitem), p as (select least(a, b) a, greatest(a, b) b, relation, confidence, created_at from r) select a, b, arg_max(relation, (created_at, confidence, relation)) relation, arg_max(confidence, (created_at, confidence, relation)) confidence from p group by a, b")
def t_relations(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_orderkey a", "l_partkey b", "l_returnflag relation", "l_discount confidence", "l_linenumber created_at")
    return memory.relation_pairs(r)


# -- text functions -------------------------------------------------------------------------------------------------
@query("select doc_id, ceil(length(text) / 4)::bigint tokens from documents where text is not null")
def c_token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.estimate_tokens(F.col("text")).cast("bigint").alias("tokens"))


_BARE = "regexp_replace(regexp_replace(text, '/\\*[\\s\\S]*?\\*/|//[^\\n]*|#[^\\n]*', ' ', 'g'), '\"(?:\\\\.|[^\"\\\\\\n])*\"|''(?:\\\\.|[^''\\\\\\n])*''|`[^`]*`', '''''', 'g')"


@query(f"""with b as (select doc_id, text, {_BARE} bare from documents where kind = 'source_file' and text is not null), x as (select doc_id, list_filter(string_split(regexp_replace(text, '[^{{}}]', '', 'g'), ''), lambda c: c <> '') l, bare from b),
d as (select doc_id, (1 + len(regexp_extract_all(bare, '\\b(?:if|for|while|case|catch|elif|except|when)\\b|&&|\\|\\||\\?(?:[^.?:]|$)')))::int cc, l from x), s as (select doc_id, unnest(l) c, unnest(range(len(l))) i from d),
r as (select doc_id, max(k) m from (select doc_id, sum(case c when '{{' then 1 else -1 end) over (partition by doc_id order by i) k from s) group by 1) select d.doc_id, cc, greatest(coalesce(r.m, 0), 0)::int nesting from d left join r using (doc_id)""")
def c_complexity(spark, d):
    return table(spark, d, "documents").where("kind = 'source_file' and text is not null").select("doc_id", T.cyclomatic(F.col("text")).alias("cc"), T.nesting_depth(F.col("text")).alias("nesting"))


@query("select doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\b((?:[a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]*)+)|(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)|(?:[a-z][a-z0-9]*(?:_[a-z0-9]+)+)|(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+))\\b', 1)))::varchar ids from documents where text is not null")
def c_identifiers(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("["), F.array_join(T.identifiers(F.col("text")), ", "), F.lit("]")).alias("ids"))


@query("select a.v version_a, b.v version_b from (select distinct unnest(regexp_extract_all(text, 'v(\\d+\\.\\d+\\.\\d+)', 1)) v from documents where text is not null) a, (select '3.0.0' v) b where list_transform(string_split(a.v, '.'), lambda x: x::int) > [3, 0, 0]")
def c_versions(spark, d):
    """All versions of all texts."""
    found = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"v(\d+\.\d+\.\d+)"), F.lit(1)))).alias("version_a"))
    v = found.distinct().withColumn("version_b", F.lit("3.0.0"))
    return v.where(T.version_key(F.col("version_a")) > T.version_key(F.col("version_b")))


@query("select p_partkey, floor(p_retailprice * 10 + 0.5) / 10 rounded, case when p_size > 40 then 'large' when p_size > 20 then 'middle' else 'small' end band from part")
def c_half_up(spark, d):
    return table(spark, d, "part").select("p_partkey", T.half_up(F.col("p_retailprice"), 1).alias("rounded"), F.when(F.col("p_size") > 40, "large").when(F.col("p_size") > 20, "middle").otherwise("small").alias("band"))


@query("with p as (select p_name, p_partkey from part) select a.p_partkey ka, levenshtein(a.p_name, 'part') as distance, sha256(a.p_name) h from p a")
def c_hash_distance(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("ka"), F.levenshtein("p_name", F.lit("part")).cast("bigint").alias("distance"), F.sha2("p_name", 256).alias("h"))


@query("select event_id, json_extract_string(props, '$.page') page, json_extract_string(props, '$.k') k from events")
def c_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


@query("with l as (select doc_id, string_split(text, chr(10)) a from documents where text is not null), e as (select doc_id, unnest(a) line, unnest(range(len(a))) i from l), g as (select *, lag(regexp_replace(line, '[0-9]+', '#', 'g')) over (partition by doc_id order by i) p, regexp_replace(line, '[0-9]+', '#', 'g') n from e) select doc_id, count(*) filter (where p is null or p <> n) kept, count(*) all_lines from g group by 1")
def c_collapse_lines(spark, d):
    from skarn.operators.logs import collapse

    lines = documents.lines_of(table(spark, d, "documents"), "doc_id", "text")
    return collapse(lines).groupBy("doc_id").agg(F.count_if("first").alias("kept"), F.count(F.lit(1)).alias("all_lines"))


QUERIES = Q
