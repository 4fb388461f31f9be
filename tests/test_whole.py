"""Queries do the whole job: every match of a text and every row of a table, on small inputs written as tables."""

import __spark_entry__ as entry


def run(spark, d, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
    return entry.queries()[name](spark, str(d)).collect()


def test_every_specifier_of_a_text(spark, tmp_path):
    rows = [("use @a/b@1.2.3, then @c/d@0.1.0 and @a/b@1.10.0", "m1"), ("@c/d@0.0.9 @a/b@1.9.9", "m2"), ("none", "m3"), (None, "m4")]
    got = run(spark, tmp_path, "v_newest_dependency", documents=(rows, "text string, source string"))
    assert {tuple(r) for r in got} == {("npm", "a/b", "1.10.0", "[m1, m2]"), ("npm", "c/d", "0.1.0", "[m1, m2]")}


def test_every_version_of_every_text(spark, tmp_path):
    rows = [(1, "v2.9.9 before v3.0.1, v10.0.0"), (200, "v3.0.0 v4.1.2 v4.1.2"), (5000, "v3.10.0"), (3, None), (4, "v1")]
    got = run(spark, tmp_path, "c_versions", documents=(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got) == [(v, "3.0.0") for v in ("10.0.0", "3.0.1", "3.10.0", "4.1.2")]


KEYS = [0, 1, 2, 4, 299, 300, 450, 700, 999, 1000, 1300, 20_000, 20_003, 70_001, 70_007]
PART = ([(k, f"Brand#{k % 25}", f"name {k}") for k in KEYS], "p_partkey bigint, p_brand string, p_name string")


def test_every_part_has_a_result(spark, tmp_path):
    import hashlib

    got = {r.ka: r.h for r in run(spark, tmp_path, "c_hash_distance", part=PART)}
    assert got == {k: hashlib.sha256(f"name {k}".encode()).hexdigest() for k in KEYS}
    got = {r.slug: r.content for r in run(spark, tmp_path, "w_apply")}
    assert got == {f"p{k}": ("new", f"Brand#{k % 25}\n\nmore", f"Brand#{k % 25}")[k % 3] for k in KEYS}
    got = {r.k: (r.b, r.n) for r in run(spark, tmp_path, "w_upsert")}
    assert got == {k: (f"Brand#{k % 25}", 1) if k % 6 < 4 else (f"BRAND#{k % 25}", 3 if k % 6 == 4 else 2) for k in KEYS}
    got = {r.k: r.state for r in run(spark, tmp_path, "v_baseline_diff")}
    assert got == {k: "RESOLVED" if k % 12 < 3 else "NEW" if k % 12 > 7 else "CHANGED" if k % 10 == 0 else "UNCHANGED" for k in KEYS}


def test_every_page_is_linted(spark, tmp_path):
    pages, n = set(KEYS), -(-len(KEYS) * 3 // 2)
    links = [(k, t) for k in KEYS for t in (k * 7 % n, k // 2)]
    want = {(f"page-{k}", f"broken page-{t}") for k, t in links if t not in pages} | {(f"page-{k}", "orphan") for k in KEYS if not any(t == k != s for s, t in links)}
    assert {tuple(r) for r in run(spark, tmp_path, "w_lint", part=PART)} == want


def test_every_order_has_its_relations(spark, tmp_path):
    rows = [(1, 5, "A", 0.1, 1), (5, 1, "R", 0.2, 2), (2000, 7, "N", 0.3, 1), (600_000, 8, "N", 0.4, 1)]
    got = run(spark, tmp_path, "t_relations", lineitem=(rows, "l_orderkey bigint, l_partkey bigint, l_returnflag string, l_discount double, l_linenumber int"))
    assert {tuple(r) for r in got} == {(1, 5, "R", 0.2), (7, 2000, "N", 0.3), (8, 600_000, "N", 0.4)}


def test_components_of_all_parts(spark, tmp_path):
    star = {
        "region": ([(0, "R")], "r_regionkey bigint, r_name string"), "nation": ([(0, "N", 0)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "customer": ([(1, "C", 0)], "c_custkey bigint, c_name string, c_nationkey bigint"), "supplier": ([(1, "S", 0)], "s_suppkey bigint, s_name string, s_nationkey bigint"),
        "orders": ([(1, 1)], "o_orderkey bigint, o_custkey bigint"), "lineitem": ([(1, 3, 1)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint"),
        "part": ([(k, "B", f"n{k}", 1) for k in range(40)], "p_partkey bigint, p_brand string, p_name string, p_size int"),
    }
    to, want = {k: (7 * k + 3) % 40 for k in range(40)}, {}
    for k in to:
        walk = [k]
        while to[walk[-1]] not in walk:
            walk.append(to[walk[-1]])
        if to[walk[-1]] == k:
            want[f"p:{k}"] = min(f"p:{x}" for x in walk)
    got = run(spark, tmp_path, "g_cycles_calls", **star)
    assert len(want) == 40 and len(got) == 40 and {r.id: r.component for r in got} == want


def test_every_embeddable_kind(spark, tmp_path):
    kinds = ["function", "method", "class", "interface", "type_alias", "component", "module", "import", "variable", None]
    rows = [(f"i{i}", k, f"n{i}", "q", "f", "s", "d") for i, k in enumerate(kinds)]
    got = run(spark, tmp_path, "x_embedding_text", nodes=(rows, "id string, kind string, name string, qualified_name string, file_path string, signature string, docstring string"))
    assert {r.id: r.text for r in got} == {f"i{i}": f"{kinds[i]} n{i}\nq\nf\ns\nd" for i in range(7)}
    assert {r.id for r in run(spark, tmp_path, "x_embedding_hashed")} == {f"i{i}" for i in range(7)}


def test_functions_in_and_outside_of_fences(spark, tmp_path):
    def f(name):
        return f"# Keeps the newest {name} pages.\ndef {name}(rows):\n    return rows\n"

    texts = {
        1: f"﻿```python\n{f('mark')}```\nprose\n```py\n{f('second')}```\n", 2: f"  ```python title='x y'\n{f('indented')}  ```\n{f('outside')}", 3: f"```\r\n{f('unclosed')}", 4: f("plain"),
        5: f"````md\n```\n{f('nested')}```\n````\n{f('after')}", 6: f'def quoted(x):\n    """Counts what nobody owns.\n\n    ```\n    quoted(1)\n    ```\n    """\n{f("below")}', 7: None,
    }
    got = run(spark, tmp_path, "p1_source_pairs", documents=(list(texts.items()), "doc_id bigint, text string"))
    assert sorted(r.qualified_name for r in got) == sorted(["mark", "second", "indented", "outside", "unclosed", "plain", "nested", "after", "quoted", "below"])


def test_report_counts_every_type_in_its_own_month(spark, tmp_path):
    jan, feb = 1735689600000, 1738368000000
    typed = [("s", "gone", "uses", jan), ("s", " gone ", "documents", feb), ("s", "gone", "uses", jan), ("s", "here", "uses", feb)]
    tables = {
        "doc_code_refs": (typed, "section_id string, qualified_name string, ref_type string, created_at bigint"), "data_code_refs": (typed, "dataset_id string, qualified_name string, ref_type string, created_at bigint"),
        "mem_links": ([("o", "gone", jan), ("o", "gone", feb)], "observation_id string, qualified_name string, created_at bigint"), "nodes": ([("n", "here", jan, None)], "id string, qualified_name string, updated_at bigint, removed_at bigint"),
    }
    got = {tuple(r) for r in run(spark, tmp_path, "p4_report", **tables)}
    assert got == {(t, m, "missing", 1, 1) for t in ("doc_code_refs", "data_code_refs") for m in ("2025-01", "2025-02")} | {("mem_links", "2025-01", "missing", 1, 1)}
    assert len(run(spark, tmp_path, "p4_found")) == 3
