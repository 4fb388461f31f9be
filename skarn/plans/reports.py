"""Queries of the catalog of datasets, reports over graphs, memory, wiki and security, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.operators import catalog, documents, graph, logs, memory, resolve, review, search, security, tabular
from skarn.plans.graphs import G, _views, g_of, seeds
from skarn.plans.problems import _TREE
from skarn.session import table
from skarn.sources import extract, formats, rules

Q: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = False):
    def add(f):
        Q[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("with recursive " + G if graph else "") + sql
        return f

    return add


# -- datasets -------------------------------------------------------------------------------------------------------
_LISTED = """select dataset_id, snapshot_at, row_count, column_count, content_hash from (select *, row_number() over (partition by dataset_id order by snapshot_at desc, row_count desc nulls last, column_count desc nulls last, content_hash desc nulls last) k
from data_dataset_history where dataset_id is not null and snapshot_at is not null) where k = 1"""
_COLS = "select * from (select *, row_number() over (partition by dataset_id, name order by updated_at desc) k from data_columns where dataset_id is not null and name is not null) where k = 1"


@query(_LISTED)
def p_datasets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.datasets(table(spark, d, "data_dataset_history"))


@query(f"select dataset_id, name, position, inferred_type, null_pct, cardinality from ({_COLS})")
def p_describe(spark, d):
    return catalog.describe(table(spark, d, "data_columns")).select("dataset_id", "name", "position", "inferred_type", "null_pct", "cardinality")


@query(f"select dataset_id, name, min_value, max_value, array_to_string(sample_values, '|') samples from ({_COLS}) where name = 'id'")
def p_describe_column(spark, d):
    return catalog.describe(table(spark, d, "data_columns"), name="id").select("dataset_id", "name", "min_value", "max_value", F.array_join("sample_values", "|").alias("samples"))


@query(f"""with c as (select x.*, l.row_count from ({_COLS}) x join ({_LISTED}) l using (dataset_id)),
h as (select *, 'Random string (' || cardinality || ' distinct values in source)' s, min_value is not null and max_value is not null known from c)
select dataset_id, name column_name, case inferred_type
when 'integer' then case when known then 'Random integer between ' || min_value || ' and ' || max_value else 'Random integer' end || case when cardinality = row_count then ' (must be unique)' else '' end
when 'float' then case when known then 'Random float between ' || min_value || ' and ' || max_value || coalesce(' (mean ≈ ' || printf('%.2f', round(mean_value, 2)) || ')', '') else 'Random float' end
when 'boolean' then 'Random boolean (true/false)'
when 'date' then case when min_value <> '' and max_value <> '' then 'Random date between ' || min_value || ' and ' || max_value else 'Random ISO date string' end
when 'string' then case when cardinality <= 10 and row_count > 20 then 'Pick from: ' || array_to_string(coalesce(sample_values, []), ', ')
  when cardinality = row_count then case when contains(lower(name), 'email') then 'Generate unique email (e.g. user{{n}}@example.com)' when contains(lower(name), 'id') then 'Generate unique ID/UUID'
    when contains(lower(name), 'name') then 'Generate unique name string' when contains(lower(name), 'url') or contains(lower(name), 'link') then 'Generate unique URL' else 'Generate unique string (' || cardinality || ' distinct in source)' end
  when len(sample_values) > 0 then s || '. Examples: ' || array_to_string(sample_values[1:3], ', ') else s end
else 'Generate ' || coalesce(inferred_type, 'null') || ' value' end
|| case when nullable and null_pct > 0.05 then ' — ' || floor(null_pct * 100 + 0.5)::bigint || '% chance of null' else '' end hint from h""")
def p_sample_hints(spark, d):
    return catalog.sample_hints(table(spark, d, "data_columns"), catalog.datasets(table(spark, d, "data_dataset_history")))


_COUNTED = "select dataset_id, count(distinct row_no) n from data_rows r where snapshot_at = (select max(snapshot_at) from data_rows m where m.dataset_id = r.dataset_id) group by 1"


@query(f"""with l as ({_LISTED}), n as ({_COUNTED}), p as (select dataset_id, count(*) k from ({_COLS}) group by 1), j as (select l.*, n.n, coalesce(p.k, 0) k from l left join n using (dataset_id) left join p using (dataset_id))
select dataset_id, 'error' severity, 'no rows' issue, row_count::varchar expected, '0' as found from j where n is null
union all select dataset_id, 'error', 'row count', row_count::varchar, n::varchar from j where n <> row_count
union all select dataset_id, 'warning', 'column count', column_count::varchar, k::varchar from j where k <> column_count
union all select dataset_id, 'warning', 'orphan refs', '0', count(*)::varchar from data_code_refs where dataset_id is not null and dataset_id not in (select dataset_id from l) group by 1""")
def p_data_lint(spark, d):
    rows = table(spark, d, "data_rows")
    last = rows.groupBy("dataset_id").agg(F.max("snapshot_at").alias("snapshot_at"))
    counted = rows.select("dataset_id", "snapshot_at", "row_no").distinct().join(last, ["dataset_id", "snapshot_at"], "left_semi").groupBy("dataset_id").agg(F.count("row_no").alias("rows"))
    return catalog.lint(catalog.datasets(table(spark, d, "data_dataset_history")), table(spark, d, "data_columns"), counted, table(spark, d, "data_code_refs"))


#: Source text made of parts: half of it reads, some write, and a few do both.
_CODE = "case p_partkey % 5 when 0 then 'x = pd.read_csv(\"./data/f' || p_size || '.csv\")' when 1 then 'df.to_parquet(''out/g' || p_size || '.parquet'')' when 2 then 'open(\"data/f' || p_size || '.csv\"); t.to_csv(\"data/f' || p_size || '.csv\")' when 3 then 'copy t from ''raw/h' || p_size || '.bin''' else 'nothing here' end"


@query(f"""with c as (select p_partkey doc, {_CODE} t from part), r as (select doc, unnest(list_concat(regexp_extract_all(t, 'read_csv\\s*\\(\\s*[''"]([^''"]+)[''"]', 1), list_concat(regexp_extract_all(t, 'open\\s*\\(\\s*[''"]([^''"]+)[''"]', 1), regexp_extract_all(t, '(?i)copy\\s+\\w+\\s+from\\s+[''"]([^''"]+)[''"]', 1)))) p, 0 w from c),
w as (select doc, unnest(list_concat(regexp_extract_all(t, 'to_csv\\s*\\(\\s*[''"]([^''"]+)[''"]', 1), regexp_extract_all(t, 'to_parquet\\s*\\(\\s*[''"]([^''"]+)[''"]', 1))) p, 1 w from c), u as (select doc, regexp_replace(p, '^\\./', '') f, max(w) w from (select * from r union all select * from w) group by all),
k as (select distinct 'data/f' || p_size || '.csv' f from part where p_size < 20 union select distinct 'raw/h' || p_size || '.bin' from part where p_size < 10)
select doc, f file_path, case when w = 1 then 'writes' else 'reads' end ref_type, case when f in (select f from k) then 1.0 else 0.7 end::double confidence from u where f in (select f from k) or regexp_matches(f, '\\.(csv|parquet)$')""")
def p_link_code(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_size < 20").selectExpr("concat('data/f', p_size, '.csv') file_path").union(p.where("p_size < 10").selectExpr("concat('raw/h', p_size, '.bin') file_path"))
    q = "'"
    s = F.col("p_size").cast("string")
    code = F.when(F.expr("p_partkey % 5 = 0"), F.concat(F.lit('x = pd.read_csv("./data/f'), s, F.lit('.csv")'))).when(F.expr("p_partkey % 5 = 1"), F.concat(F.lit(f"df.to_parquet({q}out/g"), s, F.lit(f".parquet{q})")))
    code = code.when(F.expr("p_partkey % 5 = 2"), F.concat(F.lit('open("data/f'), s, F.lit('.csv"); t.to_csv("data/f'), s, F.lit('.csv")'))).when(F.expr("p_partkey % 5 = 3"), F.concat(F.lit(f"copy t from {q}raw/h"), s, F.lit(f".bin{q}"))).otherwise("nothing here")
    return catalog.data_references(p.select(F.col("p_partkey").alias("doc"), code.alias("t")), "doc", "t", known)


@query(" union all ".join(f"select '{t}' table_name, count(*) n_rows, count(distinct {i}) n_ids, min({a}) first_at, max({a}) last_at from {t}" for t, i, a in (("mem_observations", "id", "created_at"), ("doc_sections", "id", "updated_at"), ("data_columns", "id", "updated_at"), ("nodes", "id", "updated_at"))))
def a_table_stats(spark, d):
    return catalog.counts(**{t: table(spark, d, t).select("id", at) for t, at in (("mem_observations", "created_at"), ("doc_sections", "updated_at"), ("data_columns", "updated_at"), ("nodes", "updated_at"))})


# -- reports over the graph -----------------------------------------------------------------------------------------
@query("""r as (select target id, 'in' direction, kind, source other from edges_g where target in ('c:1', 'c:3', 'p:12') union select source, 'out', kind, target from edges_g where source in ('c:1', 'c:3', 'p:12') and kind in ('imports', 'exports'))
select r.id, direction, r.kind, n.file_path, n.start_line, other from r join nodes_x n on n.id = r.other""", graph=True)
def g_rename_refs(spark, d):
    return review.rename_preview(*g_of(spark, d), seeds(spark, "c:1", "c:3", "p:12"))


@query("""c as (select a.file_path f, b.file_path t, count(*) n from edges_g e join nodes_x a on a.id = e.source join nodes_x b on b.id = e.target where e.kind = 'calls' group by all),
k as (select * from nodes_x where kind in ('function', 'method', 'class')), u as (select file_path, count(*) n from k where is_exported and id not in (select target from edges_g where kind = 'calls') group by 1)
select 'move' sort, f subject, t other, n, case when n >= 10 then 'high' else 'medium' end priority from c where n >= 5 and regexp_replace(f, '/[^/]*$', '') <> regexp_replace(t, '/[^/]*$', '')
union all select 'split', file_path, null, count(*), case when count(*) >= 30 then 'high' else 'medium' end from k group by file_path having count(*) >= 15
union all select 'extract', file_path, null, n, case when n >= 8 then 'high' else 'low' end from u where n >= 3""", graph=True)
def g_suggestions(spark, d):
    return review.suggestions(*g_of(spark, d))


_LAYERS = "lay as (select distinct file_path, case when file_path like 'lib/%' then 'library' when file_path like 'A%' then 'north' else 'south' end layer from nodes_x)"


@query(_LAYERS + """, pk as (select distinct array_to_string(string_split(a.file_path, '/')[1:2], '/') src, array_to_string(string_split(b.file_path, '/')[1:2], '/') dst, a.file_path f, b.file_path t from edges_g e join nodes_x a on a.id = e.source join nodes_x b on b.id = e.target where e.kind in ('imports', 'calls') and a.file_path <> b.file_path),
o as (select p, min(f) f from (select src p, f from pk union all select dst, t from pk) group by 1), m as (select p, layer from o join lay on lay.file_path = o.f), n as (select src, dst, count(*) n from pk where src <> dst group by all)
select x.layer source_layer, y.layer target_layer, sum(n)::bigint deps from n join m x on x.p = n.src join m y on y.p = n.dst where x.layer <> y.layer group by all""", graph=True)
def a_layer_deps(spark, d):
    n, e = _views(spark, d)
    layers = n.select("file_path", F.expr("case when file_path like 'lib/%' then 'library' when file_path like 'A%' then 'north' else 'south' end").alias("layer")).distinct()
    return review.layer_dependencies(review.package_files(n, e), layers)


@query("""with f as (select 'src/f' || l_suppkey % 40 as file, count(*) filter (where l_quantity > 20)::bigint covered, count(*) total from lineitem group by 1), a as (select * from f union all select null, sum(covered)::bigint, sum(total)::bigint from f)
select file, covered, total, round(covered * 100 / total, 1) as percent from a""")
def a_coverage(spark, d):
    l = table(spark, d, "lineitem").selectExpr("concat('src/f', l_suppkey % 40) file", "cast(l_quantity > 20 as bigint) covered", "1L total")
    return review.coverage(l)


@query("""with b as (select id, arg_max(qualified_name, (updated_at, coalesce(qualified_name, ''))) q from nodes where id is not null and updated_at < 1735689600000 group by 1), a as (select id, arg_max(qualified_name, (updated_at, coalesce(qualified_name, ''))) q from nodes where id is not null group by 1)
select coalesce(a.id, b.id) id, case when b.id is null then 'added' when a.id is null then 'removed' else 'changed' end as change, a.q as now, b.q before from a full join b on a.id = b.id where b.id is null or a.id is null or a.q is distinct from b.q""")
def g_branch_diff(spark, d):
    """The symbols now against those of an earlier time."""
    from skarn.skew import current_rows

    n = table(spark, d, "nodes").select("id", "qualified_name", "updated_at")
    return review.branch_diff(current_rows(n, ["id"], "updated_at"), current_rows(n.where("updated_at < 1735689600000"), ["id"], "updated_at"))


@query("select distinct name, kind, file_path, start_line from nodes where name ilike '%cache%' or qualified_name ilike '%cache%'")
def g_branch_search(spark, d):
    return review.branch_search(table(spark, d, "nodes"), "cache")


@query("""h as (select 'abcdef' || lpad((o_orderkey % 50)::varchar, 4, '0') hash, 'lib/' || p_brand || '/p' || p_partkey % 50 file_path, p_partkey * 10 + o_orderkey % 7 lo, p_partkey * 10 + o_orderkey % 7 + 40 hi from orders join part on p_partkey = o_orderkey % 500 where o_orderkey % 50 < 40),
k as (select h.hash, count(distinct n.id) symbols from h join nodes_x n on n.file_path = h.file_path and n.start_line <= h.hi and n.end_line >= h.lo group by 1),
c as (select 'abcdef' || lpad(i::varchar, 4, '0') hash, 'day ' || i as date, 'subject ' || i subject, 'author ' || i % 3 author from range(50) t(i))
select left(c.hash, 7) short_hash, date, subject, author, coalesce(symbols, 0) symbols from c left join k using (hash)""", graph=True)
def g_changelog(spark, d):
    n, _ = _views(spark, d)
    o = table(spark, d, "orders").where("o_orderkey % 50 < 40").join(table(spark, d, "part"), F.expr("p_partkey = o_orderkey % 500"))
    hunks = o.selectExpr("concat('abcdef', lpad(o_orderkey % 50, 4, '0')) hash", "concat('lib/', p_brand, '/p', p_partkey % 50) file_path", "p_partkey * 10 + o_orderkey % 7 first_line", "p_partkey * 10 + o_orderkey % 7 + 40 last_line")
    commits = spark.range(50).selectExpr("concat('abcdef', lpad(id, 4, '0')) hash", "concat('day ', id) date", "concat('subject ', id) subject", "concat('author ', id % 3) author")
    return review.changelog(commits, hunks, n)


@query("x as (select 'symbols' what, count(*) filter (where kind <> 'route') before, count(*) as now from nodes_x union all select 'edges', count(*) filter (where kind <> 'extends'), count(*) from edges_g) select what, before, now, now - before delta from x", graph=True)
def g_session_delta(spark, d):
    n, e = _views(spark, d)
    return review.session_delta({"symbols": n.where("kind <> 'route'"), "edges": e.where("kind <> 'extends'")}, {"symbols": n, "edges": e})


_PLACED = "from nodes where file_path is not null and start_line is not null"


@query(f"select distinct file_path, start_line, id, 'L' || start_line || '-' || end_line || '  ' || kind || ' ' || name || case when is_exported then ' [exported]' else '' end entry {_PLACED} and end_line is not null and kind is not null and name is not null")
def g_structure(spark, d):
    return review.structure(table(spark, d, "nodes").where("end_line is not null and kind is not null and name is not null")).distinct()


@query(f"select distinct file_path, start_line, id, case when trim(coalesce(signature, ''), ' ') <> '' then signature else kind || ' ' || name || ' (L' || start_line || ')' end entry {_PLACED} and kind is not null and name is not null")
def g_signatures(spark, d):
    return review.signatures(table(spark, d, "nodes").where("kind is not null and name is not null")).distinct()


@query(f"select distinct file_path, start_line, id, name || ' (L' || start_line || ')' entry {_PLACED} and kind = 'import' and name is not null")
def g_file_import_names(spark, d):
    return review.imports_and_exports(table(spark, d, "nodes").where("name is not null"), exports=False).distinct()


@query(f"select distinct file_path, start_line, id, kind || ' ' || name || ' (L' || start_line || ')' entry {_PLACED} and is_exported and kind is not null and name is not null")
def g_file_exports(spark, d):
    return review.imports_and_exports(table(spark, d, "nodes").where("kind is not null and name is not null"), exports=True).distinct()


@query("with l as (select doc_id, string_split(text, chr(10)) a from documents where text is not null) select doc_id, array_to_string(list_transform(range(3, least(len(a), 6) + 1), lambda i: i || ': ' || a[i]), chr(10)) part from l")
def g_numbered_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", review.numbered_lines(F.col("text"), 3, 6).alias("part"))


@query("with o as (select distinct id, content from mem_observations where content is not null) select id, case when contains(content, 'e') then '- ' || replace(content, chr(10), chr(10) || '- ') else '' end diff from o where not contains(content, chr(10))")
def g_line_diff(spark, d):
    """Contents of one line against themselves without their letters e: one line goes and another one comes."""
    o = table(spark, d, "mem_observations").where("content is not null and not contains(content, '\n')").select("id", "content").distinct()
    return o.select("id", F.regexp_replace(review.diff_column(F.col("content"), F.replace("content", F.lit("e"), F.lit(""))), r"\n\+ .*\z", "").alias("diff"))


@query("""w as (select 'c:5' id, 0 depth union select e.target, w.depth + 1 from w join edges_g e on e.source = w.id where e.kind in ('calls', 'references', 'extends') and w.depth < 3), m as (select id, min(depth) depth from w group by 1)
select m.id, n.kind, depth from m join nodes_x n using (id) where n.kind in ('interface', 'route') order by depth, id limit 30""", graph=True)
def g_traverse(spark, d):
    n, e = _views(spark, d)
    return graph.traverse(n, e, seeds(spark, "c:5"), 3, ["calls", "references", "extends"], ["interface", "route"], limit=30)


@query("""select * from (select 'top' side, (row_number() over (order by p_retailprice desc, p_partkey))::int as rank, p_partkey id, p_retailprice as value from part union all select 'bottom', (row_number() over (order by p_retailprice, p_partkey))::int, p_partkey, p_retailprice from part) where rank <= 5""")
def a_extremes(spark, d):
    return tabular.extremes(table(spark, d, "part"), "p_partkey", "p_retailprice")


_HITS = "t as (select p_partkey id, p_size / 10.0 fts from part where p_partkey % 3 = 0), v as (select p_partkey id, p_size / 100.0 vec from part where p_partkey % 2 = 0 and p_size / 100.0 >= 0.3), l as (select distinct l_partkey a, l_suppkey b, l_returnflag relation from lineitem where l_partkey < 300)"


@query(f"""with {_HITS}, j as (select coalesce(t.id, v.id) id, round(0.5 * coalesce(fts, 0) / greatest((select max(fts) from t), 1.0) + 0.5 * coalesce(vec, 0), 4)::double score from t full join v on t.id = v.id),
e as (select a id, relation || ' ' || b r from l union select b, relation || ' ' || a from l), g as (select id, string_agg(r, ', ' order by r) relations from e group by 1) select j.id, score, coalesce(relations, '') relations from j left join g using (id)""")
def x_memory_hybrid(spark, d):
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    t = p.where("p_partkey % 3 = 0").selectExpr("p_partkey id", "p_size / 10D fts")
    v = p.where("p_partkey % 2 = 0").selectExpr("p_partkey id", "p_size / 100D vec")
    r = l.where("l_partkey < 300").selectExpr("l_partkey a", "l_suppkey b", "l_returnflag relation").distinct()
    return search.memory_hybrid(t, v, 0.5, 0.3, r).withColumn("relations", F.array_join("relations", ", "))


@query(f"with {_HITS} select id, round(fts, 4)::double score from t")
def x_memory_text_only(spark, d):
    """Nothing reaches the floor: the scores of the text side stand."""
    p = table(spark, d, "part")
    return search.memory_hybrid(p.where("p_partkey % 3 = 0").selectExpr("p_partkey id", "p_size / 10D fts"), p.selectExpr("p_partkey id", "p_size / 100D vec"), 0.5, 5.0)


# -- memory ---------------------------------------------------------------------------------------------------------
_TS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"
_FIRST = "list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')[1:8])"


@query(f"""with o as (select content, min(id) id from mem_observations where length(content) >= 20 and topic_key is not null and kind = 'decision' group by 1), t as (select id, {_TS.format('content')} ts, {_FIRST} ask from o where id is not null),
h as (select x.id i, y.id j, len(x.ask) / len(y.ts) s from t x join t y on x.id <> y.id and list_has_all(y.ts, x.ask) where len(x.ask) > 0)
select least(i, j) a, greatest(i, j) b, max(round(s, 4)) similarity from h where s > 0.3 group by all""")
def t_conflict_scan(spark, d):
    """Decisions of topics that begin with what another one holds."""
    return memory.conflict_scan(table(spark, d, "mem_observations").where("topic_key is not null and kind = 'decision'"))


_NAME = "\\b(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:_[a-z]+)+|[A-Z]+(?:_[A-Z]+)+)\\b"


@query(f"""with a as (select distinct id, unnest(regexp_extract_all(content, '{_NAME}')) as name from mem_observations where content is not null),
n as (select name, arg_min(qualified_name, (not coalesce(is_exported, false), qualified_name)) q from nodes where kind in ('function', 'method', 'class', 'interface', 'type_alias', 'component', 'variable') and name is not null and qualified_name is not null group by 1)
select id, name, q qualified_name from a join n using (name)""")
def t_symbols_named(spark, d):
    return memory.symbols_named(table(spark, d, "mem_observations"), table(spark, d, "nodes"))


@query("""with v as (select distinct id, content from mem_observations where (valid_from is null or valid_from <= 1740000000000) and (valid_until is null or valid_until > 1740000000000) and superseded_by is null),
d as (select id doc, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') ts from v where content is not null), s as (select count(*) n, avg(len(ts)) m from d), h as (select doc, len(ts) l, len(list_filter(ts, lambda t: starts_with(t, 'clos'))) b from d),
f as (select count(*) filter (where b > 0) fb from h) select doc, round(ln(1 + (n - fb + .5) / (fb + .5)) * b * 2.2 / (b + 1.2 * (.25 + .75 * l / m)), 6) score from h, s, f where b > 0""")
def t_as_of_search(spark, d):
    return memory.as_of_search(table(spark, d, "mem_observations"), 1740000000000, "clos")


# -- security -------------------------------------------------------------------------------------------------------
_FOUND = "select l_orderkey vuln_id, l_linenumber dep_id, (l_quantity / 5)::double severity_score, case when l_returnflag = 'R' then 'affected' when l_returnflag = 'A' then 'under_investigation' else 'not_affected' end verdict, l_discount epss_score, case when l_tax > 0.02 then l_tax * 100 end risk_score, 'pkg' || l_partkey package_name from lineitem"


def _found(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey vuln_id", "l_linenumber dep_id", "l_quantity / 5 severity_score", "case when l_returnflag = 'R' then 'affected' when l_returnflag = 'A' then 'under_investigation' else 'not_affected' end verdict", "l_discount epss_score", "case when l_tax > 0.02 then l_tax * 100 end risk_score", "concat('pkg', l_partkey) package_name")


@query(f"select vuln_id, dep_id, severity_score, risk_score, package_name from ({_FOUND}) where severity_score between 7.0 and 8.9 and verdict = 'affected' and epss_score >= 0.05 order by risk_score desc nulls last, vuln_id, dep_id limit 200")
def v_list(spark, d):
    return security.vulnerability_list(_found(spark, d), "high", "affected", 0.05, "risk", 200).select("vuln_id", "dep_id", "severity_score", "risk_score", "package_name")


@query(f"""with f as (select *, case when severity_score >= 9 then 'critical' when severity_score >= 7 then 'high' when severity_score >= 4 then 'medium' when severity_score > 0 then 'low' else 'unknown' end severity from ({_FOUND}))
select 1 part, '{{"vuln_id":' || vuln_id || ',"package_name":"' || package_name || '","severity":"' || severity || '","verdict":"' || verdict || '"}}' line from f
union all select 2, '{{"findings":' || count(*) || ',"critical":' || count(*) filter (where severity = 'critical') || ',"high":' || count(*) filter (where severity = 'high') || ',"medium":' || count(*) filter (where severity = 'medium') || ',"low":' || count(*) filter (where severity = 'low') || ',"fails":' || (count(*) filter (where severity_score >= 7) > 0) || '}}' from f""")
def v_ci_report(spark, d):
    return security.ci_report(_found(spark, d))


#: Names of the graph's symbols, made such that every rule has cases: who calls what follows from the keys.
_RISKY = "case k % 11 when 0 then 'exec' when 1 then 'yaml.load' when 2 then 'md5sum' when 3 then 'query' when 4 then 'readFileSync' when 5 then 'escapeHtml' when 6 then 'loads' when 7 then 'runQuery' when 8 then 'sha1' when 9 then 'handleRequest' else 'plain' end"
_CALLER = "case k % 7 when 0 then 'hashController' when 1 then 'routeAction' when 2 then 'downloadFile' when 3 then 'digest' else 'other' end"


@query(f"""n as (select id, case when kind = 'class' then {_CALLER} else {_RISKY} end as name, file_path, 10 * k start_line from nodes_g),
c as (select distinct e.source, a.name symbol, a.file_path, a.start_line line, b.name callee from edges_g e join n a on a.id = e.source join n b on b.id = e.target where e.kind = 'calls'),
s as (select distinct source from c where regexp_matches(callee, '(?i)sanitize|escape|parameteriz|prepared|placeholder')),
r as (select *, unnest([case when callee = 'exec' then 'dangerous-eval' end, case when callee in ('yaml.load', 'loads') then 'unsafe-deserialize' end, case when callee in ('md5sum', 'sha1') and (regexp_matches(symbol, '(?i)crypto|hash|cipher|encrypt|digest') or regexp_matches(file_path, '(?i)crypto|hash|cipher|auth')) then 'hardcoded-crypto' end,
  case when callee in ('query', 'exec', 'runQuery') and regexp_matches(symbol, '(?i)handle|controller|route|request|req|endpoint|action|handler') and source not in (select source from s) then 'sql-injection' end,
  case when callee = 'readFileSync' and regexp_matches(symbol, '(?i)controller|route|request|download|upload') then 'path-traversal' end]) as rule from c)
select distinct rule, case rule when 'dangerous-eval' then 'critical' when 'sql-injection' then 'critical' when 'hardcoded-crypto' then 'medium' else 'high' end severity, file_path, line, symbol, callee from r where rule is not null""", graph=True)
def v_data_flows(spark, d):
    n, e = g_of(spark, d)
    k = F.split("id", ":")[1].cast("bigint")
    named = n.withColumn("k", k).select("id", F.when(F.col("kind") == "class", F.expr(_CALLER)).otherwise(F.expr(_RISKY)).alias("name"), "file_path", (F.col("k") * 10).alias("start_line"))
    return security.data_flows(named, e)


@query("""m as (select 'p:' || l_partkey id, case when l_returnflag = 'R' then 4 when l_quantity > 25 then 3 when l_quantity > 10 then 2 else 1 end s from lineitem where l_discount > 0.08), w as (select id, max(s) worst, count(*) matches from m group by 1),
c as (select target id, count(*) callers from edges_g where kind = 'calls' group by 1) select w.id, worst, matches, coalesce(callers, 0) callers, greatest(worst, 1) * greatest(coalesce(callers, 0), 1) score from w left join c using (id) order by score desc, id limit 100""", graph=True)
def v_security_hotspots(spark, d):
    _, e = _views(spark, d)
    m = table(spark, d, "lineitem").where("l_discount > 0.08").selectExpr("concat('p:', l_partkey) id", "case when l_returnflag = 'R' then 'critical' when l_quantity > 25 then 'high' when l_quantity > 10 then 'medium' else 'low' end severity")
    return security.security_hotspots(m, e, 100)


@query("""with p as (select distinct l_orderkey vuln_id, 'e' || l_suppkey % 9 entry_point, ['f' || l_partkey % 30, 'g' || l_linenumber, 'h' || l_suppkey % 5] path from lineitem), lay as (select 'f' || i as f, 'layer ' || i % 4 layer from range(20) t(i) union all select 'g' || i, 'ui' from range(4) t(i)),
f as (select distinct vuln_id, f.f as x, layer from (select vuln_id, unnest(path) f from p) f left join lay on lay.f = f.f)
select vuln_id, array_to_string(list_sort(list(distinct coalesce(layer, 'unclassified'))), ', ') layers, any_value(n) entry_points, any_value(k) paths from f join (select vuln_id, count(distinct entry_point) n, least(count(distinct path), 100) k from p group by 1) using (vuln_id) group by 1""")
def v_impact_summary(spark, d):
    p = table(spark, d, "lineitem").selectExpr("l_orderkey vuln_id", "concat('e', l_suppkey % 9) entry_point", "array(concat('f', l_partkey % 30), concat('g', l_linenumber), concat('h', l_suppkey % 5)) path")
    layers = spark.range(20).selectExpr("concat('f', id) file_path", "concat('layer ', id % 4) layer").union(spark.range(4).selectExpr("concat('g', id) file_path", "'ui' layer"))
    return security.impact_summary(p, layers).withColumn("layers", F.array_join("layers", ", ")).withColumn("paths", F.col("paths").cast("bigint"))


@query("""with recursive e as (select distinct 'eco' || p_size % 3 eco, p_partkey a, p_partkey // 3 b from part where p_partkey > 2 union select distinct 'eco' || p_size % 3, p_partkey, (p_partkey * 5 + 1) % 700 from part where p_partkey % 4 = 0),
w as (select distinct 'eco' || p_size % 3 eco, p_partkey p, 0 depth from part where p_partkey % 50 = 7 union select w.eco, e.b, w.depth + 1 from w join e on e.eco = w.eco and e.a = w.p where w.depth < 4)
select eco ecosystem, 'n' || p as name, min(depth) depth from w group by all""")
def v_closure(spark, d):
    p = table(spark, d, "part").withColumn("eco", F.expr("concat('eco', p_size % 3)"))
    pairs = p.where("p_partkey > 2").selectExpr("eco ecosystem", "concat('n', p_partkey) parent", "concat('n', p_partkey div 3) child").union(p.where("p_partkey % 4 = 0").selectExpr("eco", "concat('n', p_partkey)", "concat('n', (p_partkey * 5 + 1) % 700)"))
    return security.dependency_closure(p.where("p_partkey % 50 = 7").selectExpr("eco ecosystem", "concat('n', p_partkey) name"), pairs, 4)


@query("select l_orderkey vuln_id, count(distinct l_partkey) symbols from lineitem where l_partkey in (select p_partkey from part where p_size < 10) group by 1")
def v_context_warnings(spark, d):
    return security.context_warnings(table(spark, d, "part").where("p_size < 10").selectExpr("p_partkey id"), table(spark, d, "lineitem").selectExpr("l_orderkey vuln_id", "l_partkey id"))


@query("""with r as (select distinct p_brand as rule, 'A' || p_size % 7 || ':' || p_size cat from part), f as (select p_brand as rule from part join lineitem on l_partkey = p_partkey where l_quantity > 40), q as (select distinct rule, split_part(cat, ':', 1) c from r)
select c category, count(distinct q.rule) rules, (select count(*) from f join q x using (rule) where x.c = q.c) findings from q group by 1""")
def v_category_coverage(spark, d):
    p = table(spark, d, "part")
    f = table(spark, d, "lineitem").where("l_quantity > 40").join(p, F.col("l_partkey") == F.col("p_partkey")).selectExpr("p_brand rule")
    return security.category_coverage(p.selectExpr("p_brand rule", "concat('A', p_size % 7, ':', p_size) category").distinct(), f)


#: Lines of code, their language and the rules that find them.
SNIPPETS = [
    ("python", "x = eval(text)", ["dangerous-eval"]), ("javascript", "db.query('select * from t where a = ' + a)", ["sql-injection-concat"]), ("python", "  # eval(x) in a comment", []), ("go", "eval(x)", []), ("typescript", "el.innerHTML = name", ["inner-html"]),
    ("python", "subprocess.run(cmd, shell=True); os.system(cmd)", ["dangerous-exec-python"]), ("java", 'MessageDigest.getInstance("MD5")', ["weak-crypto-hash"]), ("python", "data = yaml.load(f)", ["unsafe-yaml"]), ("python", "data = yaml.load(f, Loader=SafeLoader)", []),
    ("rust", "unsafe { go() }", ["unsafe-block"]), ("javascript", "fetch(req.query.url); res.redirect(req.query.next)", ["open-redirect", "request-forgery"]), ("ruby", "evaluate(x)", []), ("typescript", "const password = 'correcthorse'; token = Math.random()", ["hardcoded-secret", "insecure-random"]),
]


@query(" union all ".join(f"select p_partkey path, {1 + p_line}::int line, '{r}' as rule from part where p_partkey % {len(SNIPPETS)} = {i}" for i, (_, _, found) in enumerate(SNIPPETS) for r in found for p_line in (0, 2)))
def v_source_rules(spark, d):
    """Files of three lines, the first and the last of which are one of the snippets."""
    pick = lambda j: F.get(F.array(*[F.lit(x[j]) for x in SNIPPETS]), (F.col("p_partkey") % len(SNIPPETS)).cast("int"))
    files = table(spark, d, "part").select(F.col("p_partkey").alias("path"), pick(0).alias("language"), F.concat(pick(1), F.lit("\nok()\n"), pick(1)).alias("content"))
    return rules.findings(files).select("path", "line", "rule")


# -- references to edges --------------------------------------------------------------------------------------------
def _references(spark, d):
    """References as a parser leaves them, made of the tables: calls by documents, imports of modules and of names in
    them, and supertypes."""
    n = table(spark, d, "nodes").where("id is not null")
    calls = table(spark, d, "doc_code_refs").where("section_id is not null").selectExpr("section_id source", "trim(qualified_name) ref_name", "'call' ref_kind", "cast(null as string) file_path", "1 line")
    imports = n.where("kind = 'import' and file_path is not null").selectExpr("id source", "replace(name, 'import:', '') ref_name", "'import' ref_kind", "file_path", "start_line line")
    named = n.where("kind = 'method' and qualified_name is not null and file_path is not null").selectExpr("id source", "if(length(id) % 2 = 0, qualified_name, concat(qualified_name, '.*')) ref_name", "'import' ref_kind", "file_path", "start_line line")
    types = n.where("kind = 'method' and name is not null").selectExpr("id source", "split(name, '[.]')[0] ref_name", "if(length(id) % 2 = 0, 'extends', 'implements') ref_kind", "file_path", "start_line line")
    return calls.unionByName(imports).unionByName(named).unionByName(types).distinct()


_REFS = """refs as (select section_id source, trim(qualified_name, ' ') ref_name, 'calls' sort, null::varchar file_path, 1 line from doc_code_refs where section_id is not null
union select id, replace(name, 'import:', ''), 'imports', file_path, start_line from nodes where id is not null and kind = 'import' and file_path is not null
union select id, case when length(id) % 2 = 0 then qualified_name else qualified_name || '.*' end, 'imports', file_path, start_line from nodes where id is not null and kind = 'method' and qualified_name is not null and file_path is not null
union select id, string_split(name, '.')[1], case when length(id) % 2 = 0 then 'extends' else 'implements' end, file_path, start_line from nodes where id is not null and kind = 'method' and name is not null),
sx as (select unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '.py', '/__init__.py']) x, unnest(range(10)) r),
im as (select distinct file_path f, ref_name s from refs where sort = 'imports' and ref_name is not null), fl as (select file_path f, min(id) id from nodes where id is not null group by 1),
rel as (select im.f, s, arg_min(fl.id, r) id from im, sx join fl on fl.f = regexp_replace(im.f, '/[^/]*$', '') || '/' || substr(s, 3) || x where starts_with(s, './') group by all),
px as (select p k, min(id) id from (select id, unnest(list_transform(range(1, len(string_split(qualified_name, '.')) + 1), lambda i: array_to_string(string_split(qualified_name, '.')[1:i], '.'))) p from nodes where kind in ('class', 'interface', 'trait', 'module', 'namespace') and qualified_name is not null and id is not null) group by 1),
wi as (select name, p, min(id) id from (select id, name, unnest(list_transform(range(1, len(string_split(qualified_name, '.')) + 1), lambda i: array_to_string(string_split(qualified_name, '.')[1:i], '.'))) p from nodes where qualified_name is not null and name is not null and id is not null) group by all),
qn as (select qualified_name q, min(id) id from nodes where id is not null and qualified_name is not null group by 1),
ic as (select f, s, id, 'import-path' st, 1 r from rel union all select f, s, px.id, 'wildcard', 2 from im join px on k = regexp_replace(s, '\\.?\\*$', '') where s like '%*' and s not like '.%'
 union all select f, s, qn.id, 'qualified', 3 from im join qn on q = s where s not like '%*' and s not like '.%' union all select f, s, wi.id, 'name in namespace', 4 from im join wi on wi.name = string_split(s, '.')[-1] and p = regexp_replace(s, '\\.[^.]*$', '') where s not like '%*' and s not like '.%' and contains(s, '.')
 union all select f, s, px.id, 'prefix', 6 from im join px on k = s where s not like '%*' and s not like '.%'),
ib as (select f, s, arg_min(id, (r, id)) id, arg_min(st, (r, id)) st from ic group by all),
ty as (select ref_name, arg_min(id, (kind not in ('class', 'interface', 'trait', 'protocol', 'struct'), id)) id from (select distinct ref_name from refs where sort in ('extends', 'implements')) join nodes on name = ref_name where id is not null group by 1),
w as (select distinct ref_name from refs where sort = 'calls' and ref_name is not null),
cc as (select ref_name, id, 'qualified' st, 1 r from w join nodes on qualified_name = ref_name where id is not null union all select ref_name, id, 'suffix', 2 from w join nodes on name = regexp_split_to_array(ref_name, '\\.|::')[-1] where regexp_matches(ref_name, '\\.|::') and id is not null
 union all select ref_name, id, 'exact', 3 from w join nodes on name = ref_name where id is not null union all select ref_name, id, 'lower', 4 from w join nodes on lower(name) = lower(ref_name) where id is not null),
cb as (select ref_name, arg_min(id, (r, id)) id, arg_min(st, (r, id)) st from cc group by 1),
j as (select refs.*, coalesce(ib.id, ty.id, qn.id, cb.id) target, coalesce(ib.st, case when coalesce(ty.id, qn.id) is not null then 'type-name' end, cb.st) strategy from refs left join ib on sort = 'imports' and ib.f = refs.file_path and ib.s = refs.ref_name
 left join ty on sort in ('extends', 'implements') and ty.ref_name = refs.ref_name left join qn on sort in ('extends', 'implements') and qn.q = refs.ref_name left join cb on sort = 'calls' and cb.ref_name = refs.ref_name where refs.ref_name is not null)
"""


@query("with " + _REFS + "select source, target, sort kind, line, strategy from j where target is not null")
def r_edges(spark, d):
    return resolve.emit_edges(_references(spark, d), table(spark, d, "nodes"))[0]


@query("with " + _REFS + """select source, ref_name, sort kind, line, case sort when 'imports' then 'import-path' when 'calls' then case when regexp_matches(ref_name, '\\.|::') then 'qualified, suffix, exact, lower' else 'qualified, exact, lower' end else 'type-name' end attempted from j where target is null""")
def r_failures(spark, d):
    f = resolve.emit_edges(_references(spark, d), table(spark, d, "nodes"))[1]
    return f.select("source", "ref_name", "kind", "line", F.array_join("attempted", ", ").alias("attempted"))


def _source_files(spark, d):
    return formats.code_fences(table(spark, d, "documents"), "doc_id", "text")


@query()
def s15_nodes(spark, d):
    """Symbols of the source text in the fences of all documents, a file each."""
    return extract.source_graph(_source_files(spark, d))[0]


@query()
def s15_edges(spark, d):
    """Containment, calls, imports and supertypes of these files, resolved among their symbols."""
    return extract.resolved_graph(_source_files(spark, d))[1]


# -- logs -----------------------------------------------------------------------------------------------------------
@query("select case when p_brand in ('graph', 'docs') then p_brand when p_size % 3 = 0 then 'graph' when p_size % 3 = 1 then 'docs' else 'exec' end as source, count(*) commands, sum(p_size * 63)::bigint saved from part group by 1")
def a_savings_by_source(spark, d):
    r = table(spark, d, "part").selectExpr("case p_size % 3 when 0 then 'graph' when 1 then 'docs' else 'elsewhere' end source", "p_size * 100 original", "p_size * 37 compressed")
    return logs.savings_by_source(r)


@query("""select p_partkey "at", p_name command, floor((p_size * 100 - p_retailprice) * 100 / (p_size * 100) + 0.5)::bigint saved_percent from part order by "at" desc, command limit 10""")
def a_latest_savings(spark, d):
    return logs.latest_savings(table(spark, d, "part").selectExpr("p_partkey at", "p_name command", "p_size * 100 original", "p_retailprice compressed"))


@query("""with c as (select user_id session_id, event_type dataset_id, epoch_ms(ts) as "at", event_id as "offset" from events), m as (select *, lag("at", 5) over w back, ("offset" > lag("offset") over w)::int r from c window w as (partition by session_id, dataset_id order by "at", "offset")),
n as (select *, min(r) over (partition by session_id, dataset_id order by "at", "offset" rows between 4 preceding and current row) k from m) select session_id, dataset_id, "at" from n where k = 1 and "at" - back <= 86400000""")
def f_repeated_paging(spark, d):
    c = table(spark, d, "events").selectExpr("user_id session_id", "event_type dataset_id", "unix_millis(cast(ts as timestamp)) at", "event_id offset")
    return logs.repeated_paging(c, 5, 86_400_000)


@query("select doc_id, case when length(text) > 400 then left(text, 400) || chr(10) || '… (truncated)' else text end shown from documents where text is not null")
def f_response_budget(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", logs.within_budget(F.col("text"), 100).alias("shown"))


@query("with r as (select event_id, sum(strlen(props) + 1) over (order by event_id desc rows unbounded preceding) used from events) select event_id from r where used <= 20000")
def z_rotation(spark, d):
    return logs.rotated(table(spark, d, "events").select("event_id", "props"), 20_000, "event_id", "props").select("event_id")


@query("select session_id, count(*) n from mem_observations where session_id is not null group by 1 having count(*) >= 12")
def z_threshold(spark, d):
    c = table(spark, d, "mem_observations").where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return logs.over_threshold(c, 12)


# -- documents and wiki ---------------------------------------------------------------------------------------------
_CUR = "select id, arg_max(struct_pack(f := file_path, t := title, a := byte_start, z := byte_end, h := content_hash, p := position), updated_at) s from doc_sections where id is not null group by 1"


@query(f"""with c as ({_CUR}), r as (select distinct section_id, qualified_name from doc_code_refs where section_id is not null and qualified_name is not null), x as (select id from c where length(id) % 3 <> 0 union select 'extra' union select 'more')
select 'broken ref' as "check", section_id subject, qualified_name detail from r where qualified_name not in (select qualified_name from nodes where qualified_name is not null) union all select 'orphan ref', section_id, qualified_name from r where section_id not in (select id from c)
union all select 'index', id, 'missing' from c where id not in (select id from x) union all select 'index', id, 'in excess' from x where id not in (select id from c)
union all select 'stale section', id, s.f from c where not (s.h is not distinct from sha256('text of ' || s.f)) """)
def d_docs_lint(spark, d):
    """The files hold a text made of their name, of which each section is the whole."""
    from skarn.skew import current_rows

    s = table(spark, d, "doc_sections").withColumn("byte_start", F.lit(0)).withColumn("byte_end", F.lit(100_000))
    cur = current_rows(s.select("id", "updated_at"), ["id"], "updated_at").select("id")
    indexed = cur.where("length(id) % 3 <> 0").union(spark.createDataFrame([("extra",), ("more",)], "id string"))
    contents = s.where("file_path is not null").select("file_path", F.concat(F.lit("text of "), "file_path").alias("text")).distinct()
    return documents.docs_lint(s, table(spark, d, "doc_code_refs"), table(spark, d, "nodes"), contents, indexed)


_HEADS = "'{\"page\":\"w' || p_size || '\",\"section\":\"S' || p_partkey % 3 || '\"' || case when p_partkey % 4 = 0 then ',\"mode\":\"replace\"' else '' end || case when p_partkey % 9 = 0 then '' else '}' end"


def _wiki_texts(spark, d):
    p = table(spark, d, "part")
    head = F.concat(F.lit('{"page":"w'), F.col("p_size").cast("string"), F.lit('","section":"S'), F.expr("p_partkey % 3").cast("string"), F.lit('"'), F.when(F.expr("p_partkey % 4 = 0"), ',"mode":"replace"').otherwise(""), F.when(F.expr("p_partkey % 9 = 0"), "").otherwise("}"))
    return p.select(F.col("p_partkey").alias("doc"), F.concat(F.lit("talk\nWIKI_DIFF_START\n"), head, F.lit("\nbody "), "p_name", F.lit("\nWIKI_DIFF_END\nWIKI_DIFF_START\n{}\nsecond\nWIKI_DIFF_END\nend")).alias("text"))


@query("""select p_partkey doc, 0 seq, 'upsert' as action, 'w' || p_size page, 'S' || p_partkey % 3 section, case when p_partkey % 4 = 0 then 'replace' else 'append' end mode, 'body ' || p_name body from part where p_partkey % 9 <> 0
union all select p_partkey, 1, 'upsert', '', null, 'append', 'second' from part""")
def w_parse_blocks(spark, d):
    return documents.parse_blocks(_wiki_texts(spark, d), "doc", "text").drop("title")


@query("""with o as (select 'w' || p_size page, p_partkey k, 'body ' || p_name body from part where p_partkey % 9 <> 0 and p_size > 10 union all select 'v' || p_size, p_partkey, 'body ' || p_name from part where p_size <= 10),
f as (select page, string_agg(body, chr(10) || chr(10) order by k) b, count(*) n from o group by 1) select page slug, page title, '# ' || page || chr(10) || chr(10) || b || chr(10) as content, n source_count from f where page like 'w%' union all select page, 'T', '# T' || chr(10) || chr(10) || (select arg_max(body, k) from o where o.page = f.page) || chr(10), n from f where page like 'v%'""")
def w_apply_blocks(spark, d):
    """Paragraphs added to pages that begin empty, and pages made anew by each block."""
    p = table(spark, d, "part")
    body = F.concat(F.lit("body "), "p_name")
    none = F.lit(None).cast("string")
    add = p.where("p_partkey % 9 <> 0 and p_size > 10").select(F.col("p_partkey").alias("doc"), F.lit(0).alias("seq"), F.lit("append").alias("action"), F.expr("concat('w', p_size)").alias("page"), none.alias("title"), none.alias("section"), F.lit("append").alias("mode"), body.alias("body"))
    new = p.where("p_size <= 10").select(F.col("p_partkey").alias("doc"), F.lit(0).alias("seq"), F.lit("create").alias("action"), F.expr("concat('v', p_size)").alias("page"), F.lit("T").alias("title"), none.alias("section"), F.lit("append").alias("mode"), body.alias("body"))
    return documents.apply_page_blocks(spark.createDataFrame([], "slug string, title string, content string, source_count bigint"), add.unionByName(new))


@query("""select 'p' || p_partkey page, 'S' section, p_partkey % 2 = 0 as resolved, case when p_partkey % 2 = 0 then 'before new' || chr(10) || '> ⚠ Superseded by src on 2025-01-0' || (1 + p_partkey % 9) || chr(10) || ' after ' || p_name end as content from part""")
def w_conflicts(spark, d):
    p = table(spark, d, "part")
    pages = p.selectExpr("concat('p', p_partkey) slug", "concat('before old claim after ', p_name) content")
    c = p.selectExpr("concat('p', p_partkey) page", "'S' section", "'old claim' existing", "'new' incoming", "'src' source", "if(p_partkey % 2 = 0, '2024-01-01', '2026-01-01') existing_date", "concat('2025-01-0', 1 + p_partkey % 9) incoming_date")
    return documents.resolve_conflicts(pages, c)


@query("select 'p' || p_partkey slug, '| [p' || p_partkey || '](wiki/p' || p_partkey || '.md) | ' || p_name || ' | ' || p_size || ' | ' || strftime(make_timestamp(1735689600000000 + p_partkey * 86400000000), '%Y-%m-%d') || ' |' line from part")
def w_manifest(spark, d):
    p = table(spark, d, "part").selectExpr("concat('p', p_partkey) slug", "concat('wiki/p', p_partkey, '.md') file_path", "p_name title", "cast(p_size as bigint) source_count", "1735689600000 + p_partkey * 86400000 updated_at")
    return documents.manifest(p)


@query("select 'p/' || p_partkey slug, case when p_size % 2 = 0 then p_name else 'p/' || p_partkey end title, case when p_size % 2 = 0 then 'x' || chr(10) || '# ' || p_name || chr(10) || 'y' else 'no heading' end as content from part")
def w_reindex(spark, d):
    p = table(spark, d, "part").selectExpr("concat('/repo/wiki/p/', p_partkey, '.md') path", "if(p_size % 2 = 0, concat('x\\n# ', p_name, '\\ny'), 'no heading') content")
    more = spark.createDataFrame([("/repo/wiki/MANIFEST.md", "# M"), ("/repo/wiki/SCHEMA.md", "# S"), ("/repo/wiki/a.txt", "# A")], "path string, content string")
    return documents.reindex_pages(p.unionByName(more))


@query("select 'p' || p_partkey slug, 'stale' finding from part where p_size % 3 = 0")
def w_review(spark, d):
    p = table(spark, d, "part").selectExpr("concat('p', p_partkey) slug", "case p_size % 3 when 0 then concat('a\\n## Sources\\n- ', p_name, '\\n\\n## Next\\n2024-01-01') when 1 then 'a\\n## Sources\\n- 2024-05-06 x' else 'none' end content")
    return documents.wiki_review(p)


_WIKI = """with w as (select 'p' || p_partkey slug, 'topic t' || p_partkey % 100 title, case p_size % 4 when 0 then 'superseded by now' when 1 then 'deprecated here' when 2 then 'is not so and deprecated' else 'fine' end as content, p_partkey % 100 t from part),
s as (select *, list_filter(['instead of', 'not', 'replaced by', 'superseded', 'deprecated'], lambda x: contains(content, x)) sig from w)"""


@query(_WIKI + " select least(a.slug, b.slug) a, greatest(a.slug, b.slug) b, list_filter(a.sig, lambda x: list_contains(b.sig, x))[1] signal from s a join s b on a.t = b.t and a.slug < b.slug where len(list_filter(a.sig, lambda x: list_contains(b.sig, x))) > 0")
def w_contradictions(spark, d):
    p = table(spark, d, "part").selectExpr("concat('p', p_partkey) slug", "concat('topic t', p_partkey % 100) title", "case p_size % 4 when 0 then 'superseded by now' when 1 then 'deprecated here' when 2 then 'is not so and deprecated' else 'fine' end content")
    return documents.contradictions(p)


@query("select p_partkey doc, p_size / 50.0 score from part where p_size / 50.0 >= 0.4 order by score desc, doc limit 3")
def w_context_pages(spark, d):
    return documents.context_pages(table(spark, d, "part").selectExpr("p_partkey doc", "cast(p_size / 50.0 as double) score"))


@query(f"""with c as ({_CUR}), b as (select section_id, max(confidence) confidence from doc_code_refs where confidence >= 0.5 and qualified_name in (select qualified_name from nodes where kind = 'class') group by 1)
select section_id, s.f file_path, s.t title, confidence from b join c on c.id = b.section_id""")
def d_path_links(spark, d):
    return documents.path_links(table(spark, d, "doc_code_refs"), table(spark, d, "doc_sections"), table(spark, d, "nodes").where("kind = 'class'").select("qualified_name"))


@query("select qualified_name, section_id, ref_type, arg_max(confidence, (confidence, created_at)) confidence from doc_code_refs where section_id is not null and qualified_name in (select qualified_name from nodes where kind = 'class') group by all")
def d_refs_both(spark, d):
    return documents.refs_both_ways(table(spark, d, "doc_code_refs"), table(spark, d, "nodes").where("kind = 'class'").select("qualified_name"))


@query(_TREE + """, p as (select id, lpad(coalesce(arg_max(position, updated_at), 0)::varchar, 10, '0') || ':' || id key from doc_sections where id is not null group by 1)
select w.id, w.depth, string_agg(p.key, '/' order by i) place from (select id, depth, path, unnest(range(1, depth + 2)) i from walk) w join p on p.id = w.path[i] group by all""")
def d_tree(spark, d):
    return documents.tree(table(spark, d, "doc_sections"))


QUERIES = Q
