"""Graph queries over a property graph that is derived from the star schema, and their SQL.

Nodes: regions, nations, customers (classes), suppliers (interfaces) and parts (functions and methods), with files below
their region and nation. Edges: containment, calls of customers to the parts they ordered, calls between parts (a
permutation, so that every part lies on one cycle), references of parts to suppliers, inheritance of parts (a binary
tree), imports between customers, and some routes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.operators import graph, ranges, review
from skarn.session import cut, table

Q: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "with recursive " + G + sql
        return f

    return add


_NODES = """nodes_g as (
  select 'r:' || r_regionkey id, 'module' kind, r_name as name, r_name || '/mod' file_path, r_regionkey k, 0 size from region
  union all select 'n:' || n_nationkey, 'namespace', n_name, r_name || '/' || n_name || '/ns', n_nationkey, 0 from nation join region on r_regionkey = n_regionkey
  union all select 'c:' || c_custkey, 'class', c_name, r_name || '/' || n_name || '/c' || c_custkey % 40, c_custkey, 0 from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
  union all select 's:' || s_suppkey, 'interface', s_name, r_name || '/' || n_name || '/s' || s_suppkey % 7, s_suppkey, 0 from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
  union all select 'p:' || p_partkey, case when p_partkey % 97 = 0 then 'route' when p_partkey % 2 = 0 then 'function' else 'method' end, p_name, 'lib/' || p_brand || '/p' || p_partkey % 50, p_partkey, p_size from part)"""
_EDGES = """edges_g as (
  select 'r:' || n_regionkey source, 'n:' || n_nationkey target, 'contains' kind from nation
  union all select 'n:' || c_nationkey, 'c:' || c_custkey, 'contains' from customer
  union all select 'n:' || s_nationkey, 's:' || s_suppkey, 'contains' from supplier
  union all select distinct 'c:' || o_custkey, 'p:' || l_partkey, 'calls' from orders join lineitem on l_orderkey = o_orderkey
  union all select 'p:' || p_partkey, 'p:' || (7 * p_partkey + 3) % (select count(*) from part), 'calls' from part
  union all select distinct 'p:' || l_partkey, 's:' || l_suppkey, 'references' from lineitem
  union all select 'p:' || p_partkey, 'p:' || p_partkey {div} 2, 'extends' from part where p_partkey > 1
  union all select 'c:' || c_custkey, 'c:' || c_custkey {div} 3, 'imports' from customer where c_custkey > 0
  union all select 'c:' || c_custkey, 'c:' || (c_custkey + 1), 'imports' from customer where c_custkey % 50 = 0 and c_custkey + 1 in (select c_custkey from customer))"""
_MORE = "id, kind, name, file_path, k % 2 = 1 is_exported, 10 * k start_line, 10 * k + size end_line, case when k % 5 = 0 then null else 'doc ' || k end docstring, 1 + size % 20 cc, 100.0 - size mi"
G = f"{_NODES},\n{_EDGES.format(div='//')},\nnodes_x as (select {_MORE} from nodes_g)\n, "


def _views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the derived graph, each written once per call of a query that walks them."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    frames = {n: table(spark, d, n) for n in names}
    sql = _NODES.replace("nodes_g as (", "", 1).rstrip()[:-1]
    edges = _EDGES.format(div="div").replace("edges_g as (", "", 1).rstrip()[:-1]
    for n in names:
        import re

        sql, edges = (re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}} {n}", s) for s in (sql, edges))
    n = spark.sql(sql, **{k: v for k, v in frames.items() if "{" + k + "}" in sql})
    e = spark.sql(edges, **{k: v for k, v in frames.items() if "{" + k + "}" in edges})
    more = _MORE.replace("100.0 - size", "cast(100.0 - size as double)")
    return n.selectExpr(*[x.strip() for x in _split(more)]), e


def _split(s: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(s[last:i])
            last = i + 1
    out = [*out, s[last:]]
    return [x.strip().replace(" is_exported", " as is_exported").replace(" start_line", " as start_line").replace(" end_line", " as end_line").replace(" docstring", " as docstring") for x in out]


def g_of(spark, d):
    """Nodes, and edges that are written once, for queries that read the edges more than once."""
    n, e = _views(spark, d)
    return n, cut(e, "edges")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _bfs_sql(start: str, depth: int | None, cond: str, step: str = "e.source = w.id", to: str = "e.target") -> str:
    """Closure with depths; SQL lists (id, depth) pairs as a set, so a depth bound ends it on cycles."""
    return f"w as (select '{start}' id, 0 depth union select {to}, w.depth + 1 from w join edges_g e on {step} where {cond} and w.depth < {depth or 40}) select id, min(depth) depth from w group by 1"


@query(_bfs_sql("c:5", 3, "e.kind in ('calls', 'references')"))
def g_bfs(spark, d):
    n, e = _views(spark, d)
    return graph.bfs(e, seeds(spark, "c:5"), 3, ["calls", "references"])


@query(_bfs_sql("p:7", None, "e.kind = 'extends'", "e.target = w.id", "e.source"))
def g_type_hierarchy(spark, d):
    n, e = _views(spark, d)
    return graph.bfs(e, seeds(spark, "p:7"), None, ["extends"], "in")


@query(_bfs_sql("s:3", 2, "true", "e.target = w.id", "e.source"))
def g_impact(spark, d):
    n, e = _views(spark, d)
    return graph.bfs(e, seeds(spark, "s:3"), 2, None, "in")


@query("w as (select 'p:9' id, 0 depth union select e.target, w.depth + 1 from w join edges_g e on e.source = w.id where e.kind = 'calls' and w.depth < 3), i as (select distinct id from w) select distinct source, target, kind from edges_g where kind = 'calls' and source in (select id from i) and target in (select id from i)")
def g_call_graph(spark, d):
    n, e = g_of(spark, d)
    return graph.induced(e.where("kind = 'calls'"), graph.bfs(e, seeds(spark, "p:9"), 3, ["calls"])).distinct()


@query("""s as (select source a, target b from edges_g where kind in ('imports', 'contains') union select target, source from edges_g where kind in ('imports', 'contains')), w as (select 'c:1' id, 0 d union select s.b, w.d + 1 from w join s on s.a = w.id where w.d < 3), l as (select id, min(d) d from w group by 1),
p as (select x.id, min(y.id) parent from l x join s on s.b = x.id join l y on y.id = s.a and y.d = x.d - 1 group by 1), k as (select id, d from l where id = 'c:40' union all select p.parent, k.d - 1 from k join p on p.id = k.id where k.d > 0) select d::int step, id from k""")
def g_shortest_path(spark, d):
    n, e = _views(spark, d)
    return graph.shortest_path(e, "c:1", "c:40", 3, kinds=["imports", "contains"])


@query("x as (select distinct target, source caller from edges_g where kind = 'calls' and target in ('p:1', 'p:2', 'p:3')) select * from x")
def g_callers(spark, d):
    n, e = _views(spark, d)
    return graph.callers(e, seeds(spark, "p:1", "p:2", "p:3"))


@query("x as (select distinct source, target callee from edges_g where kind = 'calls' and source in ('c:1', 'c:2')) select * from x")
def g_callees(spark, d):
    n, e = _views(spark, d)
    return graph.callees(e, seeds(spark, "c:1", "c:2"))


@query(_bfs_sql("c:77", None, "e.kind = 'contains'", "e.target = w.id", "e.source").replace("select id, min(depth) depth from w group by 1", "select id, min(depth) depth from w where depth > 0 group by 1"))
def g_ancestors(spark, d):
    n, e = _views(spark, d)
    return graph.bfs(e, seeds(spark, "c:77"), None, ["contains"], "in", include_start=False)


@query("x as (select target id, 1 depth from edges_g where kind = 'contains' and source = 'n:4') select distinct id, depth from x")
def g_children(spark, d):
    n, e = _views(spark, d)
    return graph.bfs(e, seeds(spark, "n:4"), 1, ["contains"], include_start=False)


_FILES = "fp as (select distinct a.file_path f, b.file_path t from edges_g e join nodes_x a on a.id = e.source join nodes_x b on b.id = e.target where e.kind = 'imports' and a.file_path <> b.file_path)"


@query(_FILES + " select f from_file, t to_file from fp")
def g_file_imports(spark, d):
    return graph.file_imports(*_views(spark, d))


@query(_FILES + """, w as (select f id, 1 depth from fp where t = (select min(t) from fp) union select fp.f, w.depth + 1 from w join fp on fp.t = w.id where w.depth < 5)
select distinct id from w where id like '%/c1%' and id <> (select min(t) from fp)""")
def g_affected_tests(spark, d):
    n, e = g_of(spark, d)
    start = graph.file_imports(n, e).agg(F.min("to_file").alias("id"))
    return review.affected_tests(n, e, start, "/c1")


@query("""i as (select distinct source src, target dst from edges_g where kind = 'imports'), w as (select src a, dst b from i union select w.a, i.dst from w join i on i.src = w.b)
select (select min(x.b) from w x where x.a = w.a and exists (select 1 from w y where y.a = x.b and y.b = w.a)) component, a id from w where a = b""")
def g_cycles(spark, d):
    n, e = _views(spark, d)
    return graph.cycles(e.where("kind = 'imports'").select(F.col("source").alias("src"), F.col("target").alias("dst")))


#: Calls between parts are a permutation: twenty doubled jumps pass over every cycle of up to a million parts.
_JUMPS = "".join(f", j{i + 1} as (select a.id, b.dst, least(a.low, b.low) low from j{i} a join j{i} b on b.id = a.dst)" for i in range(20))


@query("j0 as (select distinct source id, target dst, source low from edges_g where kind = 'calls' and source like 'p:%')" + _JUMPS + " select id, low component from j20 where (select count(*) from j0) <= 1048576")
def g_cycles_calls(spark, d):
    """Components of all parts."""
    n, e = _views(spark, d)
    c = graph.cycles(e.where("kind = 'calls' and source like 'p:%'").select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return c.select("id", "component")


@query("""i as (select distinct source a, target b from edges_g where kind = 'calls' and source like 'p:%' and target like 'p:%'), b2 as (select a, b from i union select b, a from i),
w as (select a id, a m from b2 union select b2.b, w.m from w join b2 on b2.a = w.id) select id, min(m) component from w group by 1""")
def g_components(spark, d):
    n, e = _views(spark, d)
    return graph.components(e.where("kind = 'calls' and source like 'p:%' and target like 'p:%'").select(F.col("source").alias("src"), F.col("target").alias("dst")))


@query("x as (select id from nodes_x where not is_exported and kind in ('function', 'method', 'class') and id not in (select target from edges_g)) select * from x")
def g_dead_code(spark, d):
    return graph.dead_code(*_views(spark, d)).select("id")


@query("""s as (select id, count(*) filter (where not o) in_degree, count(*) filter (where o) out_degree, count(*) filter (where kind = 'calls' and not o) calls_in, count(*) filter (where kind = 'calls' and o) calls_out,
count(*) filter (where kind = 'contains' and o) children from (select source id, true o, kind from edges_g union all select target, false, kind from edges_g) group by 1)
select n.id, coalesce(in_degree, 0) in_degree, coalesce(out_degree, 0) out_degree, coalesce(calls_in, 0) calls_in, coalesce(calls_out, 0) calls_out, coalesce(children, 0) children from nodes_x n left join s using (id)""")
def g_metrics(spark, d):
    return graph.metrics(*_views(spark, d))


@query("""x as (select id, count(*) as degree from (select source id from edges_g where kind <> 'contains' union all select target from edges_g where kind <> 'contains' and source <> target) group by 1) select * from x order by degree desc, id limit 20""")
def g_hotspots(spark, d):
    n, e = _views(spark, d)
    return graph.hotspots(n, e, 20)


@query("""x as (select distinct e.source, e.target, e.kind, string_split(a.file_path, '/') pa, string_split(b.file_path, '/') pb from edges_g e join nodes_x a on a.id = e.source join nodes_x b on b.id = e.target where e.kind <> 'contains' and a.file_path <> b.file_path),
y as (select *, (case when pa[1] = pb[1] then 1 + (case when pa[2] = pb[2] then 1 + (case when pa[3] = pb[3] then 1 else 0 end) else 0 end) else 0 end) same from x)
select source, target, kind, round((1 - same / greatest(len(pa), len(pb))) * case kind when 'calls' then 1.0 when 'imports' then 0.8 when 'extends' then 0.9 else 0.5 end, 4)::double score from y order by score desc, source, target, kind limit 50""")
def g_surprising(spark, d):
    n, e = _views(spark, d)
    return graph.surprising(n, e, 50)


@query("""a as (select source, target, kind from edges_g where kind = 'imports' and source <> 'c:3'), b as (select source, target, kind from edges_g where kind = 'imports' and target <> 'c:1'),
x as (select 'added' as change, * from (select * from b except select * from a) union all select 'removed', * from (select * from a except select * from b)) select * from x""")
def g_snapshot_diff(spark, d):
    n, e = _views(spark, d)
    i = e.where("kind = 'imports'")
    return graph.snapshot_diff(i.where("source <> 'c:3'"), i.where("target <> 'c:1'"), ["source", "target", "kind"])


@query()
def g_communities(spark, d):
    n, e = _views(spark, d)
    return graph.communities(e.where("kind in ('imports', 'extends')"))


@query()
def g_labels(spark, d):
    """Communities by label propagation."""
    n, e = _views(spark, d)
    return graph.label_communities(e.where("kind in ('imports', 'extends')"))


@query("""e as (select source, target from edges_g where kind in ('imports', 'extends') and source <> target), l as (select id, substr(id, 1, 3) community from nodes_x),
j as (select a.community ca, b.community cb from e join l a on a.id = source join l b on b.id = target), m as (select count(*)::double m, count(*) filter (where ca = cb)::double i from j),
k as (select sum(n * n) dd from (select c, count(*)::double n from (select ca c from j union all select cb from j) group by 1)) select round(i / m - dd / (4 * m * m), 6) modularity from m, k""")
def g_modularity(spark, d):
    n, e = _views(spark, d)
    return graph.modularity(e.where("kind in ('imports', 'extends')"), n.select("id", F.substring("id", 1, 3).alias("community")))


@query("""f as (select n.id, n.kind, n.name, n.is_exported, coalesce(c.k, 0) fan_out from nodes_x n left join (select source, count(distinct target) k from edges_g where kind = 'calls' group by 1) c on c.source = n.id),
u as (select id, 1 tier, fan_out from f where kind = 'route' union all select id, 2, fan_out from f where is_exported and kind in ('function', 'method') and id not in (select target from edges_g where kind = 'calls')
union all select id, 3, fan_out from f where kind in ('function', 'method') and regexp_matches(name, '(?i)(main|handler|index|init)'))
select id, min(tier) tier, max(fan_out) fan_out from u group by 1 order by tier, fan_out desc, id limit 30""")
def g_entry_points(spark, d):
    n, e = _views(spark, d)
    return graph.entry_points(n, e, 30)


_TOP5 = """c as (select distinct source, target from edges_g where kind = 'calls'), o as (select source t, count(*) k from c group by 1),
r as (select c.source, c.target, coalesce(k, 0) fan_out, row_number() over (partition by c.source order by coalesce(k, 0) desc, c.target) rk from c left join o on o.t = c.target), t5 as (select * from r where rk <= 5)"""


@query(_TOP5 + " select source, target, fan_out, rk from t5")
def g_trace_flow(spark, d):
    n, e = _views(spark, d)
    return graph.top_callees(e).select("source", "target", "fan_out", F.col("rank").cast("bigint").alias("rk"))


@query(_TOP5 + """, w as (select id seed, id, 0 depth from nodes_x where kind = 'route' union select w.seed, t5.target, w.depth + 1 from w join t5 on t5.source = w.id where w.depth < 4),
m as (select seed, id, min(depth) depth from w group by all), h as (select seed id, max(depth) hops from m group by 1)
select h.id, hops, round(least(hops / 10, 1.0) * 0.7 + case when regexp_matches(n.name, '(?i)(read|write|fetch|send|save|load|open)') then 0.3 else 0 end, 4) criticality from h join nodes_x n using (id) where hops >= 1""")
def g_flows(spark, d):
    n, e = g_of(spark, d)
    return graph.flows(n, e, n.where("kind = 'route'"), 4)


@query("x as (select e.kind, n.file_path, n.start_line, n.id from edges_g e join nodes_x n on n.id = e.source where e.kind <> 'contains' and e.target = 'p:12') select * from x")
def g_rename_preview(spark, d):
    n, e = _views(spark, d)
    return e.where("kind <> 'contains' and target = 'p:12'").join(n, F.col("source") == n["id"]).select(e["kind"], "file_path", "start_line", "id").orderBy("file_path", "start_line")


@query("""x as (select string_split(a.file_path, '/')[2] from_dir, string_split(b.file_path, '/')[2] to_dir, e.source, count(*) calls from edges_g e join nodes_x a on a.id = e.source join nodes_x b on b.id = e.target where e.kind = 'calls' group by all)
select source, to_dir, calls from x where from_dir <> to_dir and calls >= 5""")
def g_refactor_move(spark, d):
    n, e = _views(spark, d)
    part = lambda c: F.element_at(F.split(c, "/"), 2)
    j = review.ends(e.where("kind = 'calls'").select("source", "target"), n, "file_path").select("source", part("source_file_path").alias("from_dir"), part("target_file_path").alias("to_dir"))
    return j.where("from_dir <> to_dir").groupBy("source", "to_dir").agg(F.count(F.lit(1)).alias("calls")).where("calls >= 5")


@query("x as (select file_path, count(*) symbols from nodes_x group by 1 having count(*) >= 15) select * from x")
def g_refactor_split(spark, d):
    n, e = _views(spark, d)
    return n.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols")).where("symbols >= 15")


@query("x as (select id, kind, file_path, start_line from nodes_x where is_exported and file_path like 'ASIA/%') select * from x")
def g_module_api(spark, d):
    return _views(spark, d)[0].where("is_exported and file_path like 'ASIA/%'").select("id", "kind", "file_path", "start_line")


@query("x as (select id, kind from nodes_x where is_exported and docstring is null) select * from x")
def g_doc_coverage(spark, d):
    return _views(spark, d)[0].where("is_exported and docstring is null").select("id", "kind")


@query("x as (select source id, count(*) members, count(*) >= 10 god from edges_g where kind = 'contains' group by 1) select * from x")
def g_god_class(spark, d):
    return review.god_classes(_views(spark, d)[1])


@query("w as (select id, 0 depth from nodes_x where id in ('p:0', 'p:1') union all select e.source, w.depth + 1 from w join edges_g e on e.target = w.id where e.kind = 'extends'), m as (select id, max(depth) depth from w group by 1) select * from m where id in (select source from edges_g where kind = 'extends') or id in (select target from edges_g where kind = 'extends')")
def g_inheritance_depth(spark, d):
    e = _views(spark, d)[1].where("kind = 'extends'")
    return graph.depths(e.select(F.col("source").alias("child"), F.col("target").alias("parent")))


@query("""c as (select distinct source, target from edges_g where kind = 'calls') select source a, target b, 'direct' sort from c where source = target union all
select x.source, x.target, 'mutual' from c x join c y on x.source = y.target and x.target = y.source and x.source < x.target""")
def g_recursion(spark, d):
    return graph.mutual_calls(_views(spark, d)[1])


@query("x as (select id, end_line - start_line + 1 loc from nodes_x where end_line > start_line) select * from x order by loc desc, id limit 40")
def g_largest(spark, d):
    return review.largest(_views(spark, d)[0], 40)


@query("x as (select target id, count(*) fan_in from edges_g where kind in ('calls', 'imports') group by 1) select * from x order by fan_in desc, id limit 30")
def g_rank(spark, d):
    return review.ranked(_views(spark, d)[1], ["calls", "imports"], 30)


@query("x as (select id from nodes_x where kind = 'interface' and id not in (select source from edges_g where kind <> 'contains')) select * from x")
def g_unused_imports(spark, d):
    n, e = _views(spark, d)
    return review.without_edges(n.where("kind = 'interface'"), e).select("id")


@query("""i as (select distinct source src, target dst from edges_g where kind = 'imports'), c as (select distinct id from (select src id from i union select dst from i)),
w as (select src a, dst b from i union select w.a, i.dst from w join i on i.src = w.b), cyc as (select a id from w where a = b), bad as (select distinct a id from w where b in (select id from cyc) union select id from cyc),
l as (select id, 0 level from c where id not in (select src from i) union all select i.src, l.level + 1 from l join i on i.dst = l.id where i.src not in (select id from bad))
select c.id, max(l.level) as level from c left join l using (id) group by 1""")
def g_dependency_depth(spark, d):
    e = _views(spark, d)[1].where("kind = 'imports'")
    return graph.levels(e.select(F.col("source").alias("src"), F.col("target").alias("dst")))


@query("x as (select id, cc, cc > 15 flagged from nodes_x) select * from x order by cc desc, id limit 40")
def g_complexity(spark, d):
    return review.complexity(_views(spark, d)[0], 40)


@query("x as (select id, cc from nodes_x where cc >= 10 or mi <= 50 or end_line - start_line + 1 >= 50) select * from x")
def g_simplify_scan(spark, d):
    return review.to_simplify(_views(spark, d)[0])


@query("""x as (select round(avg(case when cc <= 10 then 1.0 else 0 end), 4) simple_share, (select count(*) from nodes_x where id not in (select source from edges_g) and id not in (select target from edges_g)) isolated,
(select round(avg(k), 4) from (select target, count(*) k from edges_g where kind = 'calls' group by 1)) mean_fan_in from nodes_x) select * from x""")
def g_health(spark, d):
    return review.health(*_views(spark, d))


@query("x as (select n.id, cc * count(*) risk from nodes_x n join edges_g e on e.target = n.id and e.kind = 'calls' group by n.id, cc having cc * count(*) > 200) select * from x")
def g_test_risk(spark, d):
    return review.test_risk(*_views(spark, d), 200)


_TESTS = "t as (select distinct e.target id from edges_g e join nodes_x n on n.id = e.source where n.file_path like '%/c1%')"


@query(_TESTS + " select id from nodes_x where is_exported and kind in ('function', 'method') and id not in (select id from t)")
def g_uncovered(spark, d):
    return review.uncovered(*_views(spark, d), "/c1")


@query("""h as (select distinct 'lib/' || p_brand || '/p' || p_partkey % 50 file_path, p_partkey * 10 + 2 lo, p_partkey * 10 + 4 hi from part where p_partkey % 31 = 0)
select distinct n.id from nodes_x n join h on n.file_path = h.file_path and n.start_line <= h.hi and n.end_line >= h.lo""")
def g_diff_context(spark, d):
    """Symbols whose lines overlap changed hunks."""
    n, _ = _views(spark, d)
    p = table(spark, d, "part").where("p_partkey % 31 = 0")
    hunks = p.select(F.expr("concat('lib/', p_brand, '/p', p_partkey % 50)").alias("file_path"), (F.col("p_partkey") * 10 + 2).alias("lo"), (F.col("p_partkey") * 10 + 4).alias("hi")).distinct()
    return ranges.overlapping(n, hunks, "file_path", "start_line", "end_line", "lo", "hi").select("id").distinct()


@query("""x as (select string_split(a.file_path, '/')[1] from_dir, string_split(b.file_path, '/')[1] to_dir, count(*) as edges from edges_g e join nodes_x a on a.id = e.source join nodes_x b on b.id = e.target where e.kind <> 'contains'
and string_split(a.file_path, '/')[1] in (select distinct string_split(file_path, '/')[1] f from nodes_x order by 1 limit 5) and string_split(b.file_path, '/')[1] in (select distinct string_split(file_path, '/')[1] f from nodes_x order by 1 limit 5) group by all) select * from x""")
def a_dsm(spark, d):
    n, e = _views(spark, d)
    return graph.matrix(n, e, 1, 5)


_PKG = "pk as (select distinct array_to_string(string_split(a.file_path, '/')[1:2], '/') src, array_to_string(string_split(b.file_path, '/')[1:2], '/') dst, a.file_path f, b.file_path t from edges_g e join nodes_x a on a.id = e.source join nodes_x b on b.id = e.target where e.kind in ('imports', 'calls') and a.file_path <> b.file_path)"


@query(_PKG + " select src, dst, count(*) files, list_sort(list(distinct f))[1:5]::varchar sample from pk where src <> dst group by all")
def a_package_deps(spark, d):
    p = review.package_files(*_views(spark, d)).where("src <> dst")
    # The five smallest sample files by a window with a pushed limit: no list of all files is ever made.
    from pyspark.sql.window import Window

    k = F.dense_rank().over(Window.partitionBy("src", "dst").orderBy("f"))
    few = p.select("src", "dst", "f").distinct().withColumn("k", k).where("k <= 5").groupBy("src", "dst").agg(F.array_sort(F.collect_set("f")).alias("s"))
    n = p.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("files"))
    return n.join(few, ["src", "dst"]).select("src", "dst", "files", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("sample"))


@query(_PKG + """, c as (select p package, count(distinct q) filter (where not o) ca, count(distinct q) filter (where o) ce from (select src p, dst q, true o from pk where src <> dst union all select dst, src, false from pk where src <> dst) group by 1)
select package, ca, ce, round(coalesce(ce / nullif(ca + ce, 0), 0), 4) instability from c""")
def a_coupling(spark, d):
    return graph.coupling(review.package_files(*_views(spark, d)).select("src", "dst"))


@query("""r as (select id seed from nodes_x where kind = 'route'), w as (select seed, seed id, 0 depth from r union select w.seed, e.target, w.depth + 1 from w join edges_g e on e.source = w.id where e.kind in ('calls', 'references') and w.depth < 4),
m as (select seed, id, min(depth) depth from w group by all) select id, count(*) reached_by, min(depth) hops from m where id like 's:%' group by 1""")
def v_reachability(spark, d):
    n, e = _views(spark, d)
    r = graph.multi_bfs(e, n.where("kind = 'route'"), 4, ["calls", "references"])
    return r.where("id like 's:%'").groupBy("id").agg(F.count(F.lit(1)).alias("reached_by"), F.min("depth").alias("hops"))


@query("""q as (select id from nodes_x where id in ('p:3', 'p:4', 'n:2')), r as (select target id, 'caller' as role, source other from edges_g where kind = 'calls' union select source, 'callee', target from edges_g where kind = 'calls' union select source, 'child', target from edges_g where kind = 'contains'
union select target, 'parent', source from edges_g where kind = 'contains') select r.id, role, other, n.kind, n.file_path from r join q using (id) join nodes_x n on n.id = other""")
def g_node_context(spark, d):
    n, e = _views(spark, d)
    return review.node_context(n, e, seeds(spark, "p:3", "p:4", "n:2"))


QUERIES = Q
