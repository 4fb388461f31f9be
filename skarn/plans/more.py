"""Further queries: quantised search, formats and rules, contexts, compression, suppression, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.functions import text as T
from skarn.operators import compress, documents, graph, memory, quantized, security
from skarn.plans.graphs import G, _views, g_of, seeds
from skarn.plans.problems import _TREE
from skarn.plans.texts import _query_vector
from skarn.session import table
from skarn.sources import formats, sinks

Q: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def x_quantised(spark: SparkSession, d: str) -> DataFrame:
    """The 25 nearest of one vector among codes of three bits per dimension."""
    e = table(spark, d, "embeddings")
    return quantized.search(quantized.encode(e, "vec_id", "embedding", 64, 3), _query_vector(spark, d), 25, 3)


@query("select count(*) vectors, count(*) * 24 bytes from embeddings")
def x_quantised_stats(spark, d):
    return quantized.stats(quantized.encode(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 3))


@query()
def x_lsh(spark, d):
    """Nearest of one vector by bucketed random projections."""
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings")
    if e.isEmpty():  # nothing to fit on
        return spark.createDataFrame([], "vec_id bigint, distance double")
    model, df = quantized.lsh_model(e.select("vec_id", "embedding"), "embedding", bucket=8.0)
    q = df.where("vec_id = 0").select(array_to_vector(F.col("embedding").cast("array<double>"))).first()[0]
    return model.approxNearestNeighbors(df, q, 25).select("vec_id", F.round("distCol", 4).alias("distance"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) line_no from documents where text is not null),
f as (select doc_id, line_no, unnest([case when regexp_matches(line, '\\bnoqa\\b') then 'silenced' end, case when regexp_matches(line, 'depends on [0-9a-f]+') then 'dependency' end, case when regexp_matches(line, '^- \\[ \\]') then 'open task' end]) as rule from l)
select doc_id, line_no, rule, case rule when 'silenced' then 'low' when 'dependency' then 'info' else 'medium' end severity from f where rule is not null""")
def v_pattern_matches(spark, d):
    rules = [("silenced", "low", r"\bnoqa\b"), ("dependency", "info", r"depends on [0-9a-f]+"), ("open task", "medium", r"^- \[ \]")]
    return formats.match_rules(documents.lines_of(table(spark, d, "documents"), "doc_id", "text"), rules).withColumn("line_no", F.col("line_no").cast("bigint"))


@query()
def s15_declarations(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("file_path").alias("path"), F.lit("typescript").alias("language"), F.col("text").alias("content"))
    return formats.declared_symbols(docs)


@query()
def s19_sections(spark, d):
    return formats.sections(table(spark, d, "documents"), "doc_id", "text", "rst")


#: Commands of every family, and what is none.
COMMANDS = {"git log -3": "git", " gh pr list": "github", "kubectl get pods": "docker", "pnpm add x": "package", "npm test": "test", "cargo test --all": "test", "cargo build": "package", "go test ./...": "test", "ruff check .": "lint", "aws s3 ls": "aws", "grep -rn x": "files", "gitk": "generic", "echo git": "generic"}


@query("select event_id, ['" + "', '".join(COMMANDS.values()) + f"'][event_id % {len(COMMANDS)} + 1] fam from events")
def c_router(spark, d):
    e = table(spark, d, "events").select("event_id", F.get(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("event_id") % len(COMMANDS)).cast("int")).alias("command"))
    return e.select("event_id", compress.family(F.col("command")).alias("fam"))


@query()
def c_prose(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.length("text").alias("before"), F.length(compress.shorten_column(F.col("text"), "full")).alias("after"))


@query()
def c_filters(spark, d):
    docs = table(spark, d, "documents").where("kind = 'session_log' and text is not null")
    return compress.compress_log(docs.select(F.lit("git log").alias("command"), "text"))


@query(_TREE + """, t as (select id, arg_max(title, updated_at) title from doc_sections where id is not null group by 1), a as (select w.id, w.path, i from walk w, range(1, w.depth + 1) r(i)),
n as (select a.id, string_agg(t.title, ' > ' order by i) ancestors from a join t on t.id = a.path[i] group by 1), c as (select parent_id id, count(*) children from links where parent_id is not null group by 1)
select w.id, t.title, coalesce(n.ancestors, '') ancestors, coalesce(c.children, 0) children from walk w join t using (id) left join n using (id) left join c using (id)""")
def d_section(spark, d):
    return documents.section_context(table(spark, d, "doc_sections"))


@query()
def d_summary(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.first_sentence(F.col("text")).alias("summary"))


@query("select 'p' || p_partkey slug, case when p_partkey % 3 = 0 then 'new' when p_partkey % 3 = 1 then p_brand || chr(10) || chr(10) || 'more' else p_brand end as content from part")
def w_apply(spark, d):
    p = table(spark, d, "part")
    pages = p.selectExpr("concat('p', p_partkey) slug", "p_brand content")
    blocks = p.where("p_partkey % 3 <> 2").selectExpr("concat('p', p_partkey) slug", "1L seq", "if(p_partkey % 3 = 0, 'replace', 'append') action", "if(p_partkey % 3 = 0, 'new', 'more') body")
    return documents.apply_blocks(pages, blocks)


@query("with o as (select distinct topic_key, id, created_at from mem_observations where topic_key is not null and id is not null), p as (select topic_key, lag(id) over (partition by topic_key order by created_at, id) earlier, id later from o) select * from p where earlier is not null")
def t_conflicts(spark, d):
    return memory.successive(table(spark, d, "mem_observations"), None)


@query("select id, regexp_replace(content, '(?is)<private>.*?</private>', '[private]', 'g') shown, length(content)::bigint n from (select distinct id, content from mem_observations where content is not null)")
def t_private(spark, d):
    o = table(spark, d, "mem_observations").where("content is not null").select("id", "content").distinct()
    return o.select("id", memory.without_private(F.col("content")).alias("shown"), F.length("content").cast("bigint").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity > 48 and l_partkey not in (select p_partkey from part where p_size < 25)")
def v_suppressions(spark, d):
    f = table(spark, d, "lineitem").where("l_quantity > 48").select("l_orderkey", "l_linenumber", "l_partkey")
    s = table(spark, d, "part").selectExpr("p_partkey l_partkey", "if(p_size < 10, null, if(p_size < 25, '2030-01-01', '2020-01-01')) expires")
    return security.suppressed(f, s, ["l_partkey"], "2025-01-01")


@query("select o_orderkey vuln_id, c_custkey dep_id, c_name pkg, n_name reached from orders left join customer on o_custkey = c_custkey and c_custkey % 2 = 0 left join nation on n_nationkey = c_nationkey and n_nationkey < 10")
def v_join_chain(spark, d):
    o = table(spark, d, "orders")
    v = o.selectExpr("o_orderkey vuln_id")
    c = table(spark, d, "customer").where("c_custkey % 2 = 0")
    e = o.join(c, o["o_custkey"] == c["c_custkey"]).selectExpr("c_custkey source", "o_orderkey target", "'has_vulnerability' kind")
    n = table(spark, d, "nation").where("n_nationkey < 10")
    r = c.join(n, c["c_nationkey"] == n["n_nationkey"]).selectExpr("c_custkey dep_id", "n_name reached")
    return security.findings_with_context(v, e, c.selectExpr("c_custkey dep_id", "c_name pkg"), r).select("vuln_id", "dep_id", "pkg", "reached")


@query("select p_partkey id from part where p_partkey % 7 = 0 or p_partkey not in (select l_partkey from lineitem where l_suppkey < 40)")
def v_orphan_dependencies(spark, d):
    l = table(spark, d, "lineitem").where("l_partkey % 7 <> 0").selectExpr("l_partkey source", "l_suppkey target", "'declared_in' kind")
    return security.orphan_dependencies(table(spark, d, "part").selectExpr("p_partkey id"), l, table(spark, d, "supplier").where("s_suppkey < 40").selectExpr("s_suppkey manifest"))


@query("with recursive " + G + """c as (select distinct target id from edges_g where kind = 'contains' and source = 'r:1' and target <> 'r:1'), w as (select 'r:1' id, '' place union all select c.id, c.id || '/' from c union all select e.target, c.id || '/' || e.target || '/' from c join (select distinct source, target from edges_g where kind = 'contains') e on e.source = c.id) select (row_number() over (order by place) - 1)::int as position, id from w""")
def g_dfs(spark, d):
    n, e = g_of(spark, d)
    return graph.dfs_order(e, "r:1", 2, kinds=["contains"])


@query("with recursive " + G + """c as (select distinct source, target from edges_g where kind = 'calls'), x as (select target id, 'caller' side, source other from c where target in ('p:2', 'p:3') union all select source, 'callee', target from c where source in ('p:2', 'p:3')),
r as (select *, row_number() over (partition by id, side order by other) k from x) select id, side, other from r where k <= 5""")
def g_symbol_context(spark, d):
    n, e = _views(spark, d)
    return graph.context(n, e, seeds(spark, "p:2", "p:3"))


@query("select p_partkey, case when (length(p_name) - length(replace(p_name, 'a', ''))) = 1 then replace(p_name, 'a', '<>') end edited, p_name || chr(10) || 'x' || chr(10) || p_brand inserted from part")
def g_edit_primitives(spark, d):
    p = table(spark, d, "part")
    both = F.concat("p_name", F.lit("\n"), "p_brand")
    return p.select("p_partkey", T.replace_once(F.col("p_name"), F.lit("a"), F.lit("<>")).alias("edited"), T.insert_at(both, 2, "x").alias("inserted"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) part from documents where text is not null")
def g_read_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.line_range(F.col("text"), 2, 4).alias("part"))


@query("""select p_brand cve, '{"id":"' || p_brand || '","analysis":{"state":"' || case when p_size > 30 then 'exploitable"' when p_size > 10 then 'not_affected","justification":"code_not_reachable"' else 'in_triage"' end || '},"affects":[{"ref":"' || p_name || '"}]}' as statement from part""")
def k_vex(spark, d):
    f = table(spark, d, "part").selectExpr("p_brand cve", "p_name purl", "case when p_size > 30 then 'affected' when p_size > 10 then 'not_affected' else 'under_investigation' end verdict")
    return sinks.vex(f)


@query("select n.id source, c.id target, 'calls' kind, 'inferred' confidence from (select distinct id, name from nodes where kind = 'function' and language = 'typescript') n join (select distinct id, name from nodes where kind = 'function' and language = 'java') c on n.name = c.name and n.id <> c.id")
def r_bridge(spark, d):
    n = table(spark, d, "nodes").where("kind = 'function'").select("id", "name", "language").distinct()
    return formats.bridge(n.where("language = 'typescript'").select("id", "name").distinct(), n.where("language = 'java'").select("id", "name").distinct(), ["name"])


@query("select distinct id, name from nodes where name ilike '%cache%' and kind in ('function', 'method')")
def x_like_search(spark, d):
    return table(spark, d, "nodes").where(F.col("name").ilike("%cache%") & F.col("kind").isin("function", "method")).select("id", "name").distinct()


QUERIES = Q
