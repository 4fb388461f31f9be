"""Queries of filters, joins, aggregates, profiles, windows and set operations over the star schema and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from skarn.operators import profiling, quality, tabular
from skarn.operators.tabular import Filter
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


def _filtered(name: str, column: str, op: str, value, t: str, cols: list[str], cond: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return tabular.query_rows(table(spark, d, t), [Filter(column, op, value)], cols)

    run.__name__ = name
    query(f"select {', '.join(cols)} from {t} where {cond}")(run)


_ORDER = ["o_orderkey", "o_totalprice", "o_orderstatus"]
_filtered("f_eq", "o_orderstatus", "eq", "F", "orders", _ORDER, "o_orderstatus = 'F'")
_filtered("f_neq", "o_orderstatus", "neq", "F", "orders", _ORDER, "o_orderstatus <> 'F'")
_filtered("f_gt", "o_totalprice", "gt", 250000, "orders", _ORDER, "o_totalprice > 250000")
_filtered("f_gte", "p_size", "gte", 40, "part", ["p_partkey", "p_size"], "p_size >= 40")
_filtered("f_lt", "p_size", "lt", 10, "part", ["p_partkey", "p_size"], "p_size < 10")
_filtered("f_lte", "p_size", "lte", 10, "part", ["p_partkey", "p_size"], "p_size <= 10")
_filtered("f_contains", "title", "contains", "QUERY", "doc_sections", ["id", "title", "updated_at"], "title ilike '%QUERY%'")
_filtered("f_in", "c_mktsegment", "in", ["BUILDING", "MACHINERY"], "customer", ["c_custkey", "c_mktsegment"], "c_mktsegment in ('BUILDING', 'MACHINERY')")
_filtered("f_in_empty", "c_mktsegment", "in", [], "customer", ["c_custkey"], "false")
_filtered("f_is_null", "topic_key", "is_null", True, "mem_observations", ["id", "created_at"], "topic_key is null")
_filtered("f_is_not_null", "docstring", "is_null", False, "nodes", ["id", "updated_at"], "docstring is not null")
_filtered("f_between", "l_quantity", "between", (10, 12), "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity between 10 and 12")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity >= 30 and l_returnflag = 'R' and l_discount < 0.05")
def f_conjunction(spark, d):
    return tabular.query_rows(table(spark, d, "lineitem"), [Filter("l_quantity", "gte", 30), Filter("l_returnflag", "eq", "R"), Filter("l_discount", "lt", 0.05)], ["l_orderkey", "l_linenumber"])


@query("select c_custkey from customer where c_name ilike '%:1%' or c_name ilike '%er#00000001%'")
def f_string_filter(spark, d):
    return tabular.query_rows(table(spark, d, "customer"), [tabular.parse_filter("c_name:contains:er#00000001")], ["c_custkey"])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def f_limit_offset(spark, d):
    o = table(spark, d, "orders").withColumn("neg", -F.col("o_totalprice"))
    return tabular.query_rows(o, order=["neg", "o_orderkey"], limit=50, offset=100, columns=["o_orderkey", "o_totalprice"])


@query("select count(*) total_matching from lineitem where l_shipdate < timestamp '1995-01-01'")
def f_count(spark, d):
    return tabular.count_rows(table(spark, d, "lineitem").withColumn("shipped", F.date_format("l_shipdate", "yyyy-MM-dd")), [Filter("shipped", "lt", "1995-01-01")])


@query("select id, kind, language from nodes where kind in ('function', 'method') and language in ('python', 'rust') and name ilike '%cache%'")
def f_node_filters(spark, d):
    return tabular.query_rows(table(spark, d, "nodes"), [Filter("kind", "in", ["function", "method"]), Filter("language", "in", ["python", "rust"]), Filter("name", "contains", "cache")], ["id", "kind", "language"])


@query("select distinct file_path, len(string_split(file_path, '/')) - 1 depth from nodes where file_path like 'src/%' and regexp_matches(file_path, '^src/[^/]*/[^/]*\\.py$')")
def f_path_filters(spark, d):
    from skarn.functions.text import glob_regex

    n = table(spark, d, "nodes").where(F.col("file_path").startswith("src/") & F.col("file_path").rlike(glob_regex("src/*/*.py")))
    return n.select("file_path", (F.size(F.split("file_path", "/")) - 1).cast("bigint").alias("depth")).distinct()


# -- joins ----------------------------------------------------------------------------------------------------------
@query('select o.o_orderkey "orders.o_orderkey", c.c_name "customer.c_name" from orders o join customer c on o.o_custkey = c.c_custkey')
def j_inner(spark, d):
    return tabular.join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey", "inner", ["o_orderkey", "c_name"], "orders", "customer")


@query('select c.c_custkey "customer.c_custkey", o.o_orderkey "orders.o_orderkey" from customer c left join orders o on o.o_custkey = c.c_custkey')
def j_left(spark, d):
    return tabular.join(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "left", ["c_custkey", "o_orderkey"], "customer", "orders")


@query('select o.o_orderkey "orders.o_orderkey", c.c_custkey "customer.c_custkey" from orders o right join customer c on o.o_custkey = c.c_custkey')
def j_right(spark, d):
    return tabular.join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey", "right", ["o_orderkey", "c_custkey"], "orders", "customer")


@query("select count(*) total_matching from lineitem l join part p on l.l_partkey = p.p_partkey where p.p_size > 20")
def j_count(spark, d):
    parts = tabular.where(table(spark, d, "part"), [Filter("p_size", "gt", 20)])
    return tabular.count_rows(tabular.join(table(spark, d, "lineitem"), parts, "l_partkey", "p_partkey"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 50)")
def j_semi(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 50")
    return table(spark, d, "part").join(big, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("""select n_name, r_name, count(*) customers, round(sum(c_acctbal), 2) balance from customer join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey group by all""")
def j_star(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""select a.l_orderkey, a.l_linenumber line_a, b.l_linenumber line_b from lineitem a join lineitem b
on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.l_linenumber < b.l_linenumber""")
def j_self(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("line_a"))
    b = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("line_b"))
    return a.join(b, ["l_orderkey", "l_suppkey"]).where("line_a < line_b").select("l_orderkey", "line_a", "line_b")


_NOW = "cur as (select id, arg_max(file_path, updated_at) file_path, arg_max(start_line, updated_at) s, arg_max(end_line, updated_at) e from nodes where id is not null group by id)"


@query(f"with {_NOW} select a.id outer_id, b.id inner_id from cur a join cur b on a.file_path = b.file_path and a.s <= b.s and a.e >= b.e and a.id <> b.id and (a.e - a.s) > (b.e - b.s)")
def j_range(spark, d):
    """Pairs of symbols of which one's lines contain the other's: equality on the file, a bucket of lines, then the range."""
    from skarn.operators.ranges import containing
    from skarn.skew import current_rows

    now = current_rows(table(spark, d, "nodes").select("id", "file_path", "start_line", "end_line", "updated_at"), ["id"], "updated_at")
    return containing(now, "file_path", "start_line", "end_line", "id")


@query(f"""with {_NOW}, p as (select id, file_path, s line from cur where id like 'variable:%'),
h as (select p.id point_id, c.id node_id, c.e - c.s span from p join cur c on p.file_path = c.file_path and p.line between c.s and c.e and c.id <> p.id)
select point_id, arg_min(node_id, (span, node_id)) node_id from h group by 1""")
def j_innermost(spark, d):
    from skarn.operators.ranges import innermost
    from skarn.skew import current_rows

    now = current_rows(table(spark, d, "nodes").select("id", "file_path", "start_line", "end_line", "updated_at"), ["id"], "updated_at")
    points = now.where(F.col("id").startswith("variable:")).select(F.col("id").alias("point_id"), "file_path", F.col("start_line").alias("line"))
    return innermost(points, now, "file_path", "line", "start_line", "end_line", "point_id", "id")


@query("""with q as (select distinct qualified_name q from mem_links where qualified_name is not null), f as (select distinct file_path f from nodes where file_path is not null)
select q qualified_name, arg_max(f, (length(f), f)) longest from q join f on starts_with(q, f || '::') group by 1""")
def j_longest_prefix(spark, d):
    from skarn.operators.ranges import longest_prefix

    names = table(spark, d, "mem_links").where("qualified_name is not null").select("qualified_name").distinct()
    files = table(spark, d, "nodes").where("file_path is not null").select("file_path").distinct()
    return longest_prefix(names, files, "qualified_name", "file_path", "::")


@query("""select id, valid_from from mem_observations where (valid_from is null or valid_from <= 1735689600000)
and (valid_until is null or valid_until > 1735689600000) and superseded_by is null""")
def j_as_of_predicate(spark, d):
    from skarn.operators.memory import as_of

    return as_of(table(spark, d, "mem_observations"), 1735689600000).select("id", "valid_from")


@query("""with h as (select dataset_id, snapshot_at, max(row_count) row_count from data_dataset_history where dataset_id is not null group by all),
r as (select distinct dataset_id, snapshot_at as "at" from data_rows)
select r.dataset_id, r."at", arg_max(h.row_count, h.snapshot_at) row_count from r left join h on h.dataset_id = r.dataset_id and h.snapshot_at <= r."at" group by all""")
def j_as_of_native(spark, d):
    """As-of join (an extension): the latest history row at or before each load."""
    from skarn.operators.ranges import as_of_join

    left = table(spark, d, "data_rows").select("dataset_id", F.col("snapshot_at").alias("at")).distinct()
    h = table(spark, d, "data_dataset_history").where("dataset_id is not null").groupBy("dataset_id", "snapshot_at").agg(F.max("row_count").alias("row_count"))
    return as_of_join(left, h, "dataset_id", "at", "snapshot_at", ["row_count"])


# -- aggregates -----------------------------------------------------------------------------------------------------
@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_price, round(avg(l_discount), 6) avg_disc,
count(*) n, count(distinct l_suppkey) suppliers from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def a_group_by(spark, d):
    m = [("sum", "l_quantity", "sum_qty"), ("sum", "l_extendedprice", "sum_price"), ("avg", "l_discount", "avg_disc"), ("count", "*", "n"), ("count_distinct", "l_suppkey", "suppliers")]
    l = table(spark, d, "lineitem")
    out = tabular.aggregate(l.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")), ["l_returnflag", "l_linestatus"], m)
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "sum_price": F.round("sum_price", 2), "avg_disc": F.round("avg_disc", 6)})


@query("select count(*) n, count(p_name) named, count(distinct p_brand) brands, min(p_size) min_size, max(p_retailprice) max_price from part")
def a_global(spark, d):
    return tabular.aggregate(table(spark, d, "part"), [], [("count", "*", "n"), ("count", "p_name", "named"), ("count_distinct", "p_brand", "brands"), ("min", "p_size", "min_size"), ("max", "p_retailprice", "max_price")])


@query("select o_custkey, count(*) n from orders group by 1 having count(*) >= 12")
def a_having(spark, d):
    return tabular.aggregate(table(spark, d, "orders"), ["o_custkey"], [("count", "*", "n")], having="n >= 12")


@query("select event_type, count(*) filter (where value > 50) high, count(*) filter (where value <= 50) low from events group by 1")
def a_conditional(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"))


@query("select round(avg(n), 4) mean_orders from (select o_custkey, count(*) n from orders group by 1)")
def a_nested(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 4).alias("mean_orders"))


@query("""select s_suppkey, coalesce(a.n, 0) lines, coalesce(b.n, 0) parts from supplier left join (select l_suppkey, count(*) n from lineitem group by 1) a on a.l_suppkey = s_suppkey
left join (select l_suppkey, count(distinct l_partkey) n from lineitem group by 1) b on b.l_suppkey = s_suppkey""")
def a_degree_counts(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("p"))
    s = table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce("p", F.lit(0)).alias("parts"))


@query("select kind, language, count(*) n from nodes group by all")
def a_histogram(spark, d):
    return table(spark, d, "nodes").groupBy("kind", "language").agg(F.count(F.lit(1)).alias("n"))


@query("select kind, count(*) n, round(count(*) * 100 / (select count(*)::double from nodes), 2) as percent from nodes group by kind")
def a_distribution(spark, d):
    return profiling.distribution(table(spark, d, "nodes"), "kind")


@query("select t tag, count(*) n from (select unnest(tags) t from mem_observations) group by 1")
def a_array_histogram(spark, d):
    return table(spark, d, "mem_observations").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


_RANK = "case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 1 else 0 end"


@query(f"select o_custkey, arg_max(o_orderpriority, {_RANK}) worst from orders group by 1")
def a_worst_severity(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.expr(f"max_by(o_orderpriority, {_RANK})").alias("worst"))


_GINI = """with r as (select {x}::double x, row_number() over (order by {x}) i, count(*) over () n from {t})
select max(n) n, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) gini from r"""


@query(_GINI.format(x="o_totalprice", t="orders"))
def a_gini(spark, d):
    return tabular.gini(table(spark, d, "orders"), "o_totalprice").withColumn("gini", F.round("gini", 6))


@query(_GINI.format(x="(end_line - start_line + 1)", t="nodes where end_line is not null and start_line is not null"))
def a_gini_loc(spark, d):
    n = table(spark, d, "nodes").withColumn("loc", F.col("end_line") - F.col("start_line") + 1)
    return tabular.gini(n, "loc").withColumn("gini", F.round("gini", 6))


@query("""with c as (select corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_discount) b, corr(l_extendedprice, l_discount) c, count(*) n from lineitem),
u as (select unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) column_a, unnest(['l_extendedprice', 'l_discount', 'l_discount']) column_b, unnest([a, b, c]) r, n from c)
select column_a, column_b, round(r, 4) r, n, case when abs(r) >= .7 then 'strong' when abs(r) >= .4 then 'moderate' when abs(r) >= .2 then 'weak' else 'none' end strength from u""")
def a_correlation(spark, d):
    return tabular.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], threshold=0.0)


@query("select lower(p_type) name, count(*) entries, count(distinct p_brand) versions from part group by 1 having count(*) > 1 and count(distinct p_brand) > 1")
def a_version_drift(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_type").alias("name")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("p_brand").alias("versions")).where("entries > 1 and versions > 1")


@query("select strftime(ts, '%Y-%m-%d') as event_day, event_type, count(*) n, round(sum(value), 2) total from events group by all")
def a_daily(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("event_day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select string_split(dataset_id, '-')[2] family, count(*) n, sum(row_count)::bigint all_rows, cast(floor(avg(column_count) + 0.5) as bigint) columns_mean from data_dataset_history group by 1")
def a_savings_style(spark, d):
    h = table(spark, d, "data_dataset_history")
    return h.groupBy(F.element_at(F.split("dataset_id", "-"), 2).alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("all_rows"), F.floor(F.avg("column_count") + 0.5).alias("columns_mean")
    )


@query("""with f as (select distinct string_split(file_path, '/') p from nodes where file_path is not null),
t as (select array_to_string(p[1:i], '/') as path, i::int depth, p from f, range(1, 4) r(i) where i <= len(p)) select path, depth, count(*) files from t group by all""")
def a_file_tree(spark, d):
    from skarn.functions.text import path_prefixes

    f = table(spark, d, "nodes").where("file_path is not null").select("file_path").distinct()
    t = f.select(F.posexplode(F.slice(path_prefixes(F.col("file_path")), 1, 3)).alias("depth", "path"))
    return t.groupBy("path", (F.col("depth") + 1).alias("depth")).agg(F.count(F.lit(1)).alias("files"))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by rollup (o_orderstatus, o_orderpriority)")
def x_rollup(spark, d):
    """Native extension."""
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by cube (o_orderstatus, o_orderpriority)")
def x_cube(spark, d):
    """Native extension."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def x_grouping_sets(spark, d):
    """Native extension."""
    return table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, row_number() over w rn, rank() over w rk, dense_rank() over w dr, ntile(4) over w nt, round(percent_rank() over w, 6) pr,
lag(o_totalprice) over w before, lead(o_totalprice) over w after, first_value(o_totalprice) over w "first", nth_value(o_totalprice, 2) over w "second"
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def x_windows(spark, d):
    """Native extension: ranking and analytic window functions, partitioned by customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.ntile(4).over(w).cast("bigint").alias("nt"),
        F.round(F.percent_rank().over(w), 6).alias("pr"), F.lag(p).over(w).alias("before"), F.lead(p).over(w).alias("after"), F.first(p).over(w).alias("first"), F.nth_value(p, 2).over(w).alias("second"),
    )


@query("""select l_orderkey, l_linenumber, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between 1 preceding and 1 following), 2) near,
round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber), 2) running from lineitem""")
def x_frames(spark, d):
    """Native extension: row and range frames."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    total = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(total.rowsBetween(-1, 1)), 2).alias("near"), F.round(F.sum("l_quantity").over(w), 2).alias("running"))


@query("select o_orderkey, o_custkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) k from orders) where k <= 2")
def s_top_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 2").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select id, complexity_cyclomatic from (select distinct id, complexity_cyclomatic from nodes) order by complexity_cyclomatic desc nulls last, id limit 25")
def s_top_nulls_last(spark, d):
    return tabular.top(table(spark, d, "nodes").select("id", "complexity_cyclomatic").distinct(), 25, F.desc_nulls_last("complexity_cyclomatic"), F.asc("id"))


@query("select distinct c_nationkey from customer union select s_nationkey from supplier")
def s_union_distinct(spark, d):
    return table(spark, d, "customer").select("c_nationkey").union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("select p_partkey from part except select l_partkey from lineitem where l_quantity > 45")
def s_except(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("select qualified_name from mem_links intersect select qualified_name from doc_code_refs")
def s_intersect(spark, d):
    return table(spark, d, "mem_links").select("qualified_name").intersect(table(spark, d, "doc_code_refs").select("qualified_name"))


@query("""with u as (select c_custkey k, 1 p from customer where c_acctbal > 9000 union all select o_custkey, 2 from orders where o_totalprice > 400000)
select k, min(p) p from u group by k""")
def s_ordered_union(spark, d):
    u = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("k"), F.lit(1).alias("p")).unionByName(
        table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"), F.lit(2).alias("p"))
    )
    return u.groupBy("k").agg(F.min("p").alias("p"))


# -- profiling ------------------------------------------------------------------------------------------------------
_PART = ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


def _profile_sql(t: str, cols: tuple) -> str:
    cells = " union all ".join(f"select {i} as position, '{c}' as column_name, {c}::varchar as raw from {t}" for i, c in enumerate(cols))
    return f"""with cells as ({cells}), v as (select position, column_name, case when lower(trim(raw)) in ('', 'null', 'na', 'n/a') then null else trim(raw) end as value from cells),
k as (select *, case when value is null then null when lower(value) in ('true', 'false') then 'boolean' when regexp_full_match(value, '-?\\d+') then 'integer'
 when regexp_full_match(value, '-?\\d+\\.\\d+|-?\\d+[eE][+-]?\\d+') then 'float' when regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_cast(value[1:10] as date) is not null then 'date' else 'string' end kind from v),
t as (select position, column_name, count(*) row_count, count(*) - count(value) null_count, count(distinct value) as cardinality, list_sort(list(distinct kind) filter (where kind is not null)) kinds,
 min(value) min_text, max(value) max_text, min(try_cast(value as double)) filter (where kind in ('integer', 'float')) min_number, max(try_cast(value as double)) filter (where kind in ('integer', 'float')) max_number,
 avg(try_cast(value as double)) filter (where kind in ('integer', 'float')) mean_value, mode(kind) top, max(row_count) m from (select *, 1 row_count from k) group by all)
"""


def _simple_profile(t: str, cols: tuple) -> str:
    return _profile_sql(t, cols).replace(", mode(kind) top, max(row_count) m from (select *, 1 row_count from k)", " from k")


@query(_simple_profile("part", _PART) + """select column_name, case when len(kinds) = 0 then 'null' when len(kinds) = 1 then kinds[1] when kinds = ['float', 'integer'] then 'float' else 'mixed' end inferred_type,
row_count, null_count, round(null_count / row_count, 6) null_pct, "cardinality", min_number, max_number, min_text, max_text, round(mean_value, 4) mean_value from t""")
def p_profile(spark, d):
    p = profiling.profile(table(spark, d, "part"), list(_PART))
    return p.drop("position").withColumns({"null_pct": F.round("null_pct", 6), "mean_value": F.round("mean_value", 4)})


@query(_simple_profile("mem_observations", ("content_hash", "topic_key", "valid_until", "kind")) + """select column_name, round(least(case when null_count / row_count > .5 then .4 when null_count / row_count > .2 then .2 when null_count / row_count > .05 then .1 else 0 end
+ case when "cardinality" = 1 and row_count > 10 then .3 when "cardinality" = row_count and kinds = ['string'] then .1 else 0 end, 1), 4)::double risk from t""")
def p_quality(spark, d):
    return profiling.quality(profiling.profile(table(spark, d, "mem_observations"), ["content_hash", "topic_key", "valid_until", "kind"])).select("column_name", "risk")


@query()
def p_summary(spark, d):
    return profiling.summary(profiling.profile(table(spark, d, "part"), list(_PART)))


@query(_simple_profile("part", _PART) + """, r as (select column_name, unnest([case when null_count = 0 then 'required' end, case when kinds = ['integer'] or kinds = ['float'] or kinds = ['float', 'integer'] then 'type ' || case when len(kinds) = 2 then 'float' else kinds[1] end end,
case when "cardinality" <= 20 and row_count > 50 then 'enumeration' end, case when "cardinality" = row_count then 'unique' end]) rule from t) select * from r where rule is not null""")
def p_rules(spark, d):
    return profiling.rules(profiling.profile(table(spark, d, "part"), list(_PART))).where("not startswith(rule, 'range')")


@query("select id, name from data_columns where lower(name) like '%sensor%' or lower(array_to_string(sample_values, ' ')) like '%sensor%' or lower(summary) like '%sensor%'")
def p_search_columns(spark, d):
    return profiling.search_columns(table(spark, d, "data_columns"), "sensor").select("id", "name")


@query("""select dataset_id, snapshot_at, k from (select dataset_id, snapshot_at, row_number() over (partition by dataset_id order by snapshot_at desc) k from
(select distinct dataset_id, snapshot_at from data_dataset_history)) where k <= 5""")
def p_history(spark, d):
    return profiling.history(table(spark, d, "data_dataset_history"), 5).select("dataset_id", "snapshot_at", F.col("rank").cast("bigint").alias("k"))


@query("""with h as (select distinct dataset_id, snapshot_at, row_count from data_dataset_history), r as (select *, row_number() over (partition by dataset_id order by snapshot_at desc) k from h)
select a.dataset_id, a.row_count rows_now, b.row_count rows_before, a.row_count - b.row_count as delta from r a join r b on a.dataset_id = b.dataset_id and a.k = 1 and b.k = 2""")
def p_row_delta(spark, d):
    return profiling.row_delta(table(spark, d, "data_dataset_history"))


@query("""with h as (select distinct dataset_id, snapshot_at, columns_json from data_dataset_history where json_valid(columns_json) and json_type(columns_json) = 'ARRAY'), two as (select *, row_number() over (partition by dataset_id order by snapshot_at desc) k, count(*) over (partition by dataset_id) loads from h),
c as (select dataset_id, k, json_extract_string(c, '$.name') as name, json_extract_string(c, '$.type') t, json_extract_string(c, '$.cardinality')::double card, json_extract_string(c, '$.nullPct')::double np from (select dataset_id, k, unnest(json_extract(columns_json, '$[*]')) c from two where k <= 2 and loads >= 2)),
j as (select coalesce(a.dataset_id, b.dataset_id) dataset_id, coalesce(a.name, b.name) column_name, case when a.name is null then 'removed' when b.name is null then 'added' when a.t is distinct from b.t then 'type' when abs(a.np - b.np) > 0.05 + 1e-12 then 'null_pct'
 when a.card <> b.card and greatest(a.card, b.card) >= 2 * least(a.card, b.card) then 'cardinality' end what from (select * from c where k = 1) a full join (select * from c where k = 2) b on a.dataset_id = b.dataset_id and a.name = b.name) select * from j where what is not null""")
def p_drift(spark, d):
    return quality.drift(table(spark, d, "data_dataset_history"))


@query("""select inferred_type, count(*) n from (select case when v is null then 'null' when lower(v) in ('true', 'false') then 'boolean' when regexp_full_match(v, '-?\\d+') then 'integer'
when regexp_full_match(v, '-?\\d+\\.\\d+|-?\\d+[eE][+-]?\\d+') then 'float' when regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}') and try_cast(v[1:10] as date) is not null then 'date' else 'string' end inferred_type
from (select case when lower(trim(min_value)) in ('', 'null', 'na', 'n/a') then null else trim(min_value) end v from data_columns)) group by 1""")
def s10_value_inference(spark, d):
    return table(spark, d, "data_columns").groupBy(profiling.sniff(F.col("min_value")).alias("inferred_type")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = Q
