"""Queries of the general data problems (hierarchies, orphans, quality, intervals) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.operators import hierarchy, intervals, orphans, quality
from skarn.session import cut, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.build(table(spark, d, "doc_sections"), with_paths=False).cycles()


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.build(table(spark, d, "doc_sections"))
    return h.reached.select("id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.build(table(spark, d, "doc_sections")).descendants()


def _orphans(spark: SparkSession, d: str, typed: bool = False) -> DataFrame:
    """typed: the type of the reference is part of the key, as it is in the tables."""
    sources = (("mem_links", "observation_id"), ("doc_code_refs", "section_id"), ("data_code_refs", "dataset_id"))
    kinds = {t: (F.lit(None).cast("string") if t == "mem_links" else F.col("ref_type")).alias("ref_type") for t, _ in sources}
    refs = orphans.reference_state(*[orphans.reference_deltas(table(spark, d, t), t, owner, more=(kinds[t],) if typed else ()) for t, owner in sources])
    return orphans.orphans(refs, orphans.existence_state(orphans.existence_deltas(table(spark, d, "nodes"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("first_at")


#: Time at which the first states of p4_incremental are written, and the references that are withdrawn after it.
CUT_OFF, WITHDRAWN = 1735689600000, "dataset_id like '%1%'"


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """States of all changes before a time are written, then merged with the later ones; some references are withdrawn."""
    at = F.lit(CUT_OFF)
    early, late = [], []
    for t, owner in (("mem_links", "observation_id"), ("doc_code_refs", "section_id"), ("data_code_refs", "dataset_id")):
        r = table(spark, d, t)
        early.append(orphans.reference_deltas(r.where((F.col("created_at") < at) | F.col("created_at").isNull()), t, owner))
        late.append(orphans.reference_deltas(r.where(F.col("created_at") >= at), t, owner))
        if t == "data_code_refs":
            late.append(orphans.reference_deltas(r.where(WITHDRAWN), t, owner, sign=-1))
    n = table(spark, d, "nodes")
    before = cut(orphans.reference_state(*early), "references"), cut(orphans.existence_state(orphans.existence_deltas(n.where(F.col("updated_at") < at))), "existence")
    now = orphans.merge(*before, late, [orphans.existence_deltas(n.where((F.col("updated_at") >= at) | F.col("updated_at").isNull()))])
    return orphans.orphans(*now).drop("first_at")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Each row of the tables' own keys counts in its own month."""
    return orphans.orphan_report(_orphans(spark, d, typed=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_cases(table(spark, d, "data_rows"), table(spark, d, "data_columns"), table(spark, d, "data_dataset_history"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Footer-first profile of every column of every table."""
    table(spark, d, "region")  # ships the package to the executors
    return quality.profile_parquet(spark, {t: f"{d}/{t}.parquet" for t in COLUMNS}).drop("footer_chunks", "dictionary_chunks", "decoded_chunks", "read_bytes")


def _cover(spark: SparkSession, d: str) -> intervals.Coverage:
    return intervals.cover(table(spark, d, "mem_observations"), "topic_key", "valid_from", "valid_until")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _cover(spark, d).gaps.withColumnRenamed("entity", "topic_key")


def p7_periods(spark: SparkSession, d: str) -> DataFrame:
    return _cover(spark, d).periods.withColumnRenamed("entity", "topic_key")


#: Columns of the tables: i whole number, b truth value, d number, t text, s time, [] list.
COLUMNS = {
    "customer": "c_custkey:i c_name:t c_nationkey:i c_acctbal:d c_mktsegment:t",
    "data_code_refs": "dataset_id:t qualified_name:t ref_type:t confidence:d created_at:i",
    "data_columns": "id:t dataset_id:t name:t position:i inferred_type:t nullable:b null_count:i null_pct:d cardinality:i min_value:t max_value:t mean_value:d sample_values:t[] summary:t updated_at:i",
    "data_dataset_history": "id:i dataset_id:t snapshot_at:i row_count:i column_count:i columns_json:t content_hash:t",
    "data_rows": "dataset_id:t snapshot_at:i row_no:i row_json:t",
    "doc_code_refs": "section_id:t qualified_name:t ref_type:t confidence:d created_at:i",
    "doc_sections": "id:t file_path:t title:t level:i parent_id:t summary:t byte_start:i byte_end:i content_hash:t tags:t[] position:i updated_at:i",
    "doc_vectors": "section_id:t embedding:d[] model:t created_at:i",
    "documents": "doc_id:i text:t lang:t source:t n_chars:i kind:t file_path:t indexed_at:s",
    "embeddings": "vec_id:i embedding:d[] label:i",
    "events": "event_id:i ts:s user_id:i event_type:t value:d props:t",
    "kg_nodes": "node_id:t name:t kind:t file_path:t signature:t embedding:d[]",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:t l_linestatus:t l_shipdate:s",
    "mem_links": "observation_id:t qualified_name:t relevance:d created_at:i",
    "mem_observations": "id:t session_id:t content:t content_raw:t content_hash:t kind:t source:t tags:t[] created_at:i valid_from:i valid_until:i superseded_by:t fact_type:t topic_key:t review_after:i",
    "mem_vectors": "observation_id:t embedding:d[] model:t created_at:i",
    "name_lexicon": "token:t name_part:t",
    "nation": "n_nationkey:i n_name:t n_regionkey:i",
    "nodes": "id:t kind:t name:t qualified_name:t file_path:t language:t start_line:i end_line:i docstring:t signature:t is_exported:b decorators:t[] complexity_cyclomatic:i maintainability_index:d nesting_depth:i updated_at:i removed_at:i",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:d o_orderdate:s o_orderpriority:t",
    "pack_sizes": "pack_name:t capacity_tokens:i",
    "part": "p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:d",
    "region": "r_regionkey:i r_name:t",
    "supplier": "s_suppkey:i s_name:t s_nationkey:i s_acctbal:d",
}


def _profile_sql(name: str, column: str, kind: str) -> str:
    nested = kind.endswith("[]")
    values = f"(select {column} v from {name})"
    elements = f"(select unnest({column}) v from {name})" if nested else values
    ends = {"i": "min(v)::varchar low, max(v)::varchar high", "b": "min(v::int)::varchar low, max(v::int)::varchar high", "t": "min(v) low, max(v) high", "s": "min(v)::varchar low, max(v)::varchar high", "d": "null::varchar low, null::varchar high"}[kind[0]]
    number = "(min(v) filter (where not isnan(v)))::double low_number, (max(v) filter (where not isnan(v)))::double high_number" if kind[0] == "d" else "null::double low_number, null::double high_number"
    shape = "regexp_replace(regexp_replace(v, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '9', 'g')"
    odd = f"(select case when max(n) >= sum(n) * 0.9 then sum(n) - max(n) else 0 end from (select count(*) n from (select distinct v from {values} where v is not null) group by {shape}))" if kind == "t" else "0"
    counts = f"(select count(*) n_rows, count(*) - count(v) nulls, count(distinct v) distinct_values, coalesce({odd}, 0)::bigint odd_values from {values})"
    return f"select '{name}' table_name, '{column}' column_name, * from {counts}, (select {ends}, {number} from {elements})"


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p4_found, p4_incremental, p4_report, p5_found, p5_profile, p7_found, p7_periods)}

_SECTIONS = """
cur as (select id, nullif(arg_max(coalesce(parent_id, ''), updated_at), '') parent_id from doc_sections where id is not null group by id),
links as (select c.id, p.id parent_id from cur c left join cur p on c.parent_id = p.id)
"""
_TREE = f"""
with recursive {_SECTIONS},
walk as (
  select id, id root_id, 0 depth, [id] path from links where parent_id is null
  union all
  select l.id, w.root_id, w.depth + 1, list_append(w.path, l.id) from walk w join links l on l.parent_id = w.id
)
"""
_COVER = """
with r as (
  select topic_key, valid_from a, coalesce(valid_until, 9223372036854775807) z from mem_observations
  where topic_key is not null and valid_from is not null and (valid_until is null or valid_until > valid_from)
),
m as (select *, max(z) over (partition by topic_key order by a, z rows between unbounded preceding and 1 preceding) p from r)
"""
_ORPHANS = r"""
with raw as (
  select 'mem_links' ref_table, observation_id owner_id, qualified_name q, created_at from mem_links
  union all select 'doc_code_refs', section_id, qualified_name, created_at from doc_code_refs
  union all select 'data_code_refs', dataset_id, qualified_name, created_at from data_code_refs
),
refs as (
  select ref_table, owner_id, regexp_replace(q, '^\s+|\s+$', '', 'g') qualified_name, min(created_at) first_at
  from raw where regexp_replace(q, '^\s+|\s+$', '', 'g') <> '' group by all
),
ex as (select qualified_name, max((updated_at, removed_at is null)) last, min(updated_at) seen_at from nodes where qualified_name is not null group by 1),
found as (
  select ref_table, owner_id, qualified_name, first_at,
    case when e.last is null then 'missing' when not e.last[2] then 'deleted' when seen_at > first_at then 'late' end reason
  from refs left join ex e using (qualified_name)
)
"""

_QUALITY = r"""
with claims as (select dataset_id, name, arg_max(struct_pack(n := null_pct, c := "cardinality", t := inferred_type, lo := min_value, hi := max_value), updated_at) s from data_columns group by all),
last as (select dataset_id, max(snapshot_at) snap from data_rows group by 1),
recs as (select r.dataset_id, r.row_no, max(r.row_json) j from data_rows r join last l on r.dataset_id = l.dataset_id and r.snapshot_at = l.snap group by all),
raw as (select c.dataset_id, c.name, regexp_replace(json_extract_string(j, '$."' || c.name || '"'), '^\s+|\s+$', '', 'g') v from claims c join recs r using (dataset_id)),
vals as (select dataset_id, name, case when lower(v) in ('', 'null', 'na', 'n/a') then null else v end v from raw),
kinds as (select *, case when v is null then null when lower(v) in ('true', 'false') then 'boolean' when regexp_full_match(v, '-?\d+') then 'integer' when regexp_full_match(v, '-?\d+\.\d+|-?\d+[eE][+-]?\d+') then 'float'
  when regexp_matches(v, '^\d{4}-\d{2}-\d{2}') and try_cast(v[1:10] as date) is not null then 'date' else 'string' end k, regexp_replace(regexp_replace(v, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '9', 'g') sh from vals),
shapes as (select dataset_id, name, max(n) top_shape from (select dataset_id, name, sh, count(*) n from kinds where v is not null group by all) group by all),
major as (select dataset_id, name, arg_max(k, n) k, max(n) n from (select dataset_id, name, k, count(*) n from kinds where k is not null group by all) group by all),
st as (select dataset_id, name, count(*) total, count(v) filled, count(distinct v) card, coalesce(list_sort(list(distinct k) filter (where k is not null)), []) ks,
  min(try_cast(v as double)) filter (where k in ('integer', 'float')) lo, max(try_cast(v as double)) filter (where k in ('integer', 'float')) hi from kinds group by all),
p as (select st.*, coalesce(top_shape, 0) top_shape, case when len(ks) = 0 then 'null' when len(ks) = 1 then ks[1] when ks = ['float', 'integer'] then 'float' when m.n > total * 0.8 then m.k else 'mixed' end ct
  from st left join shapes using (dataset_id, name) left join major m using (dataset_id, name)),
checks as (select dataset_id, name, unnest([case when abs(s.n - (total - filled) / total) > 0.01 + 1e-12 then 'null_pct' end, case when s.c is distinct from card then 'cardinality' end, case when s.t is distinct from ct then 'inferred_type' end,
  case when ct in ('integer', 'float') and (try_cast(s.lo as double) is distinct from lo or try_cast(s.hi as double) is distinct from hi) then 'range' end,
  case when ct in ('string', 'date') and top_shape >= filled * 0.9 and top_shape < filled then 'pattern' end]) check_name from p join claims using (dataset_id, name)),
h as (select distinct dataset_id, snapshot_at, columns_json from data_dataset_history where json_valid(columns_json) and json_type(columns_json) = 'ARRAY'),
two as (select *, row_number() over (partition by dataset_id order by snapshot_at desc) k, count(*) over (partition by dataset_id) loads from h),
cols as (select dataset_id, k, json_extract_string(c, '$.name') name, json_extract_string(c, '$.type') t, json_extract_string(c, '$.cardinality')::double card, json_extract_string(c, '$.nullPct')::double np
  from (select dataset_id, k, unnest(json_extract(columns_json, '$[*]')) c from two where k <= 2 and loads >= 2)),
d as (select coalesce(a.dataset_id, b.dataset_id) dataset_id, coalesce(a.name, b.name) as name from (select * from cols where k = 1) a full join (select * from cols where k = 2) b on a.dataset_id = b.dataset_id and a.name = b.name
  where a.name is null or b.name is null or a.t <> b.t or abs(a.np - b.np) > 0.05 + 1e-12 or (a.card <> b.card and greatest(a.card, b.card) >= 2 * least(a.card, b.card)))
"""
ORACLES = {
    "p5_profile": " union all ".join(_profile_sql(t, *c.split(":")) for t, cols in COLUMNS.items() for c in cols.split()),
    "p5_found": _QUALITY + "select dataset_id, name column_name, check_name from checks where check_name is not null union all select dataset_id, name, 'drift' from d",
    "p3_found": f"""
with recursive {_SECTIONS},
ok as (select id from links where parent_id is null union select l.id from ok join links l on l.parent_id = ok.id),
un as (select * from links where id not in (select id from ok)),
reach as (select id, parent_id to_id from un union select r.id, u.parent_id from reach r join un u on u.id = r.to_id)
select least(id, (select min(to_id) from reach q where q.id = r.id and exists (select 1 from reach b where b.id = q.to_id and b.to_id = q.id))) cycle_id, id
from reach r where to_id = id
""",
    "p3_hierarchy": _TREE + "select id, root_id, depth, array_to_string(path, ' > ') path from walk",
    "p3_descendants": _TREE + "select path[i] ancestor_id, id descendant_id, (depth - i + 1)::int distance from walk, range(1, depth + 1) t(i)",
    "p4_found": _ORPHANS + "select ref_table, owner_id, qualified_name, reason from found where reason is not null",
    "p4_incremental": _ORPHANS + "select ref_table, owner_id, qualified_name, reason from found where reason is not null and not (ref_table = 'data_code_refs' and owner_id like '%1%')",
    "p4_report": _ORPHANS.replace("created_at from mem_links", "created_at, null::varchar ref_type from mem_links").replace("qualified_name, created_at from d", "qualified_name, created_at, ref_type from d")
    .replace("'^\\s+|\\s+$', '', 'g') qualified_name,", "'^\\s+|\\s+$', '', 'g') qualified_name, ref_type,").replace("select ref_table, owner_id, qualified_name, first_at,", "select ref_table, owner_id, qualified_name, ref_type, first_at,")
    + """select ref_table, strftime(make_timestamp(first_at * 1000), '%Y-%m') "month", reason, count(*) orphans, count(distinct qualified_name) names
from found where reason is not null group by all""",
    "p7_found": _COVER + "select topic_key, p gap_from, a gap_until from m where a > p",
    "p7_periods": _COVER
    + """, g as (select *, count(*) filter (where p is null or a > p) over (partition by topic_key order by a, z rows unbounded preceding) k from m)
select topic_key, min(a) period_from, nullif(max(z), 9223372036854775807) period_until from g group by topic_key, k""",
}
