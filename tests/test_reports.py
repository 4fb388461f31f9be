"""Catalog, reports, memory, security and wiki on small tables: nulls, ties, empty sides."""

import pytest

from skarn.functions import text
from skarn.operators import catalog, documents, graph, memory, ranges, review, security


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_lint_of_the_catalog(spark):
    h = frame(spark, [("a", 2, 10, 2, "h2"), ("a", 1, 9, 9, "h1"), ("a", 2, 10, 2, "h2"), ("b", 1, 5, 1, "x"), ("c", 1, 3, 0, "y"), (None, 1, 1, 1, "z"), ("d", None, 1, 1, "z")], "dataset_id string, snapshot_at bigint, row_count bigint, column_count int, content_hash string")
    listed = catalog.datasets(h)
    assert rows(listed.select("dataset_id", "row_count")) == {("a", 10), ("b", 5), ("c", 3)}
    cols = frame(spark, [("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", None, 1)], "dataset_id string, name string, updated_at bigint")
    counted = frame(spark, [("a", 10), ("b", 4)], "dataset_id string, rows bigint")
    refs = frame(spark, [("gone", "q"), ("gone", "r"), ("a", "q"), (None, "q")], "dataset_id string, qualified_name string")
    files = frame(spark, [("a", "h2"), ("b", "other")], "dataset_id string, content_hash string")
    got = rows(catalog.lint(listed, cols, counted, refs, files).select("dataset_id", "severity", "issue", "expected", "found"))
    assert got == {
        ("b", "error", "row count", "5", "4"), ("b", "warning", "column count", "1", "0"), ("b", "warning", "content changed", "x", "other"), ("c", "error", "no rows", "3", "0"), ("c", "error", "source missing", "y", None), ("gone", "warning", "orphan refs", "0", "2"),
    }
    assert catalog.lint(listed.limit(0), cols.limit(0), counted.limit(0), refs.limit(0)).count() == 0


def test_links_to_data_files(spark):
    code = [
        ("a", "pd.read_csv('./data/x.csv'); t.to_csv(\"data/x.csv\")"), ("b", "fs.readFileSync(`raw/z.bin`)"), ("c", "COPY t FROM 'in/q.tsv'; \\\\copy t from 'in/r.tsv'"), ("d", "x = 'notes.pdf' + open('a.JSON')"), ("e", None), ("f", ""), ("g", "readFile('win\\\\dir\\\\p.parquet')"),
    ]
    known = frame(spark, [("data/x.csv", "ds"), ("raw/z.bin", "zz"), ("data/x.csv", "ds")], "file_path string, dataset_id string")
    refs = catalog.data_references(frame(spark, code, "id string, t string"), "id", "t", known)
    assert rows(refs) >= {("a", "data/x.csv", "writes", 1.0), ("b", "raw/z.bin", "reads", 1.0), ("c", "in/q.tsv", "reads", 0.7), ("d", "notes.pdf", "reads", 0.7)}
    assert rows(catalog.link_data(refs, known)) == {("ds", "a", "writes", 1.0), ("zz", "b", "reads", 1.0)}
    assert {r.doc for r in catalog.data_references(frame(spark, code, "id string, t string"), "id", "t").collect()} == {"a", "c", "d", "g"}


def test_overlapping_ranges_meet_once(spark):
    a = [(f"a{i}", "f", s, e) for i, (s, e) in enumerate([(0, 500), (60, 70), (63, 64), (64, 64), (200, 100), (10, 10)])]
    b = [(f"b{i}", "f", s, e) for i, (s, e) in enumerate([(0, 63), (64, 130), (499, 600), (501, 510), (0, 1000)])] + [("n", None, 1, 2)]
    got = ranges.overlapping(frame(spark, a, "l string, k string, s int, e int"), frame(spark, b, "r string, k string, rs int, re int"), "k", "s", "e", "rs", "re").select("l", "r").collect()
    want = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_line_diff():
    assert review.line_diff(None, "a") == "" and review.line_diff("a", "a") == ""
    assert review.line_diff("a\nb", "a\nx\nb") == "+ x" and review.line_diff("a\nb\nc", "a\nc") == "- b\n+ c\n- c"
    assert review.line_diff("a", "a\nb\nc") == "+ b\n+ c" and review.line_diff("a\nb", "a") == "- b" and review.line_diff("a", None) == "- a\n+ "
    assert review.line_diff("a\nz", "1\n2\n3\n4\n5\na\nz").startswith("- a\n+ 1")


def test_branches_and_sessions(spark):
    a, b = (frame(spark, r, "id string, qualified_name string") for r in ([("1", "x"), ("2", "y"), ("3", None), ("5", None)], [("2", "y2"), ("3", None), ("4", "w"), ("5", "v")]))
    assert rows(review.branch_diff(a, b)) == {("1", "added", "x", None), ("2", "changed", "y", "y2"), ("4", "removed", None, "w"), ("5", "changed", None, "v")}
    assert rows(review.session_delta({"symbols": a}, {"symbols": b.limit(1)})) == {("symbols", 4, 1, -3)}


def test_conflicts_between_observations(spark):
    long = "prefer small commits in the ledger module always please"
    o = [("1", long, "t"), ("2", long.upper() + "!", "t"), ("3", "Prefer small commits in the ledger module always, or not", "t"), ("4", "too short", "t"), ("5", None, "t"), ("6", long, "t"), ("7", "unrelated words that nobody else has written here", "t")]
    obs = frame(spark, o, "id string, content string, ts string")
    got = {(r.a, r.b) for r in memory.conflict_scan(obs).collect()}
    assert got == {("1", "2"), ("1", "3"), ("2", "3")}
    assert {(r.a, r.b) for r in memory.conflict_scan(obs, frame(spark, [("2", "1")], "a string, b string")).collect()} == {("1", "3"), ("2", "3")}
    assert memory.conflict_scan(obs.limit(0)).count() == 0


def test_symbols_in_texts(spark):
    n = frame(spark, [("fooBar", "z.fooBar", "function", False), ("fooBar", "a.fooBar", "method", True), ("fooBar", "b.fooBar", "method", True), ("snake_case", "m.snake_case", "constant", True), ("X", "q.X", "class", True)], "name string, qualified_name string, kind string, is_exported boolean")
    o = frame(spark, [("1", "uses fooBar and fooBar, snake_case and X"), ("2", None), ("3", "xfooBary"), ("4", "FooBar9 fooBar9")], "id string, content string")
    assert rows(memory.symbols_named(o, n)) == {("1", "fooBar", "a.fooBar")}


def test_flows_and_hotspots(spark):
    n = frame(spark, [("1", "handleIt", "src/a.ts", 3), ("2", "query", "", 1), ("3", "escapeHtml", "x", 1), ("4", "routeB", "src/b.ts", 5), ("5", "MD5", "x", 1), ("6", "go", "src/auth/c.ts", 7), ("7", "exec", "x", 9)], "id string, name string, file_path string, start_line int")
    e = frame(spark, [(a, b, "calls") for a, b in (("1", "2"), ("1", "2"), ("1", "3"), ("4", "2"), ("6", "5"), ("4", "5"), ("4", "7"), ("2", "7"))], "source string, target string, kind string")
    got = {(r.rule, r.symbol, r.callee) for r in security.data_flows(n, e).collect()}
    assert got == {("sql-injection", "routeB", "query"), ("hardcoded-crypto", "go", "MD5"), ("dangerous-eval", "routeB", "exec"), ("sql-injection", "routeB", "exec")}
    m = frame(spark, [("weak", "high", "src/b.ts", 5, "here")], "rule string, severity string, file_path string, line int, symbol string")
    assert {(r.rule, r.symbol) for r in security.data_flows(n, e, m).collect()} == {("weak", "here"), ("hardcoded-crypto", "go")}
    hot = security.security_hotspots(frame(spark, [("2", "low"), ("2", "critical"), ("9", "odd"), (None, "high")], "id string, severity string"), e)
    assert rows(hot) == {("2", 4, 2, 3, 12), ("9", 0, 1, 0, 1)}


def test_vulnerability_list(spark):
    f = frame(spark, [(i, 1, s, v, x, r, f"p{i}") for i, (s, v, x, r) in enumerate([(9.5, "affected", 0.5, None), (7.0, "affected", 0.1, 3.0), (8.9, "not_affected", None, 9.0), (None, None, None, None), (7.5, "affected", 0.9, 3.0)])], "vuln_id int, dep_id int, severity_score double, verdict string, epss_score double, risk_score double, package_name string")
    ids = lambda **k: [r.vuln_id for r in security.vulnerability_list(f, **k).collect()]
    assert ids() == [2, 1, 4, 0, 3] and ids(severity="HIGH") == [2, 1, 4] and ids(verdict="affected", sort="epss") == [4, 0, 1] and ids(epss=0.5, n=1) == [4] and ids(sort="name")[0] == 0
    with pytest.raises(ValueError):
        security.vulnerability_list(f, verdict="maybe")
    assert '"fails":true' in security.ci_report(f).where("part = 2").first().line and '"fails":false' in security.ci_report(f.limit(0)).where("part = 2").first().line


def test_wiki_blocks(spark):
    t = frame(spark, [(1, 'x WIKI_DIFF_START\n{"page": "p", "section": "Use"}\nfirst  \nWIKI_DIFF_END WIKI_DIFF_START\n{"page": "q", "action": "create", "title": "Q"}\nbody\nWIKI_DIFF_END'), (2, 'WIKI_DIFF_START\n{"page": "p", "section": "Use", "mode": "replace"}\nsecond\nWIKI_DIFF_END\nWIKI_DIFF_START\n{"page": "old", "action": "append"}\nmore\nWIKI_DIFF_END'), (3, "WIKI_DIFF_START\nbroken\nx\nWIKI_DIFF_END"), (4, None), (5, 'WIKI_DIFF_START\n{"page":"r"}\nWIKI_DIFF_END')], "doc int, text string")
    blocks = documents.parse_blocks(t, "doc", "text")
    assert rows(blocks.select("doc", "seq", "action", "page", "mode")) == {(1, 0, "upsert", "p", "append"), (1, 1, "create", "q", "append"), (2, 0, "upsert", "p", "replace"), (2, 1, "append", "old", "append")}
    pages = frame(spark, [("old", "Old", "# Old\n\n## Use\nkept\n", 2), ("still", "Still", "# S\n", 1)], "slug string, title string, content string, source_count bigint")
    got = {r.slug: (r.title, r.content, r.source_count) for r in documents.apply_page_blocks(pages, blocks).collect()}
    assert got == {"old": ("Old", "# Old\n\n## Use\nkept\n\nmore\n", 3), "still": ("Still", "# S\n", 1), "p": ("p", "# p\n\n## Use\nsecond\n", 2), "q": ("Q", "# Q\n\nbody\n", 1)}
    put = lambda content, mode: frame(spark, [(content, "B", "new\n\n", mode)], "c string, s string, b string, m string").select(documents.put_section(*[graph.F.col(x) for x in "csbm"])).first()[0]
    page = "# T\n\n## A\nx\n\n## B\nold\n\n## C\ny\n"
    assert put(page, "replace") == "# T\n\n## A\nx\n\n## B\nnew\n\n## C\ny\n" and put(page, "append") == "# T\n\n## A\nx\n\n## B\nold\nnew\n\n## C\ny\n" and put("# T\n", "append") == "# T\n\n## B\nnew\n"
    c = frame(spark, [(1, 'WIKI_DIFF_CONFLICTS\n{"page":"old","section":"Use","existing":"kept","incoming":"fresh","source":"s","incomingDate":"2025-02-01"}\nnot json\n\nWIKI_DIFF_CONFLICTS_END'), (2, None)], "doc int, text string")
    found = documents.parse_conflicts(c, "doc", "text")
    assert found.count() == 1
    assert rows(documents.resolve_conflicts(pages, found)) == {("old", "Use", True, "# Old\n\n## Use\nfresh\n> ⚠ Superseded by s on 2025-02-01\n\n")}


def test_deep_paths_and_levels(spark):
    paths = ["a/" * 12 + "../" * 12 + "z", "/a/../../b", "../x", "./a//b/./c", "a\\b", "", "a/..", "../../a/../b", None]
    got = [r.p for r in frame(spark, [(i, p) for i, p in enumerate(paths)], "i int, c string").orderBy("i").select(text.normalise_path(graph.F.col("c")).alias("p")).collect()]
    assert got == ["z", "/../b", "../x", "a/b/c", "a/b", "", "", "../../b", None]


def test_levels_have_no_bound(spark):
    chain = frame(spark, [(i, i + 1) for i in range(12)] + [(100, 101), (101, 100)], "src int, dst int")
    got = {r.id: r.level for r in graph.levels(chain).collect()}
    assert got == {**{i: 12 - i for i in range(13)}, 100: None, 101: None}


def test_values_carried_over_ranges(spark):
    from skarn import skew

    rows = [("hot", i, i if i % 5 == 0 else None, i % 3) for i in range(300)] + [("a", 1, None, 1), ("b", 1, 7, 2), ("b", 2, None, 3)]
    df = frame(spark, rows, "k string, t int, v int, w int")
    got = {(r.k, r.t): (r.last, r.before) for r in skew.carried(skew.carried(df, "k", ["t"], "v", "last", True), "k", ["t"], "v", "before", False).collect()}
    assert got == {**{("hot", i): (i - i % 5, (i - 1) - (i - 1) % 5 if i else None) for i in range(300)}, ("a", 1): (None, None), ("b", 1): (7, None), ("b", 2): (7, 7)}
    total = {(r.k, r.t): r.s for r in skew.running_sum(df, "k", ["t"], "w", "s").collect()}
    assert all(total["hot", i] == sum(j % 3 for j in range(i + 1)) for i in range(300)) and total["b", 2] == 5
    assert skew.carried(df.limit(0), "k", ["t"], "v", "last", True).count() == 0


def test_labels_are_partitions(spark, tmp_path):
    from skarn.sources import sinks

    for label in ("main", "feature/a b", "old"):
        sinks.save_label(frame(spark, [("1",)], "id string"), f"{tmp_path}/t", label)
    assert sinks.labels(spark, f"{tmp_path}/t") == ["feature/a b", "main", "old"]
    sinks.remove_label(spark, f"{tmp_path}/t", "none")
    assert sinks.keep_labels(spark, f"{tmp_path}/t", ["main", "feature/a b"]) == ["old"] and sinks.labels(spark, f"{tmp_path}/t") == ["feature/a b", "main"]


def test_hashed_vectors_add_up(spark):
    from skarn.operators import search

    df = frame(spark, [(1, "alpha beta alpha"), (2, ""), (3, None), (4, "alpha")], "id int, t string")
    got = {r.id: r.v for r in df.select("id", search.hashed_vector(graph.F.col("t"), 16).alias("v")).collect()}
    assert got[3] is None and got[2] == [0.0] * 16 and sorted(map(abs, got[4]))[-2:] == [0.0, 1.0]
    assert sum(map(abs, got[1])) in (3.0, 1.0) and sum(abs(x) == 2 for x in got[1]) <= 1 and len(got[1]) == 16


def test_memory_search_of_one_side(spark):
    from skarn.operators import search

    t, v = frame(spark, [(1, 4.0), (2, 2.0)], "id int, fts double"), frame(spark, [(2, 0.8), (3, 0.2)], "id int, vec double")
    assert rows(search.memory_hybrid(t, v)) == {(1, 0.5), (2, 0.65), (3, 0.1)}
    assert rows(search.memory_hybrid(t, v.limit(0))) == {(1, 4.0), (2, 2.0)} and rows(search.memory_hybrid(t.limit(0), v, floor=0.5)) == {(2, 0.8)}
    r = frame(spark, [(2, 9, "supports"), (9, 2, "refutes")], "a int, b int, relation string")
    assert {(x.id, tuple(x.relations)) for x in search.memory_hybrid(t, v, relations=r).collect()} == {(1, ()), (2, ("refutes 9", "supports 9")), (3, ())}
    assert search.memory_hybrid(t.limit(0), v.limit(0)).count() == 0


def test_rules_from_files_and_symbols_around(spark, tmp_path):
    from skarn.sources import extract, rules

    (tmp_path / "r.json").write_text('{"rules": [{"id": "todo", "pattern": "TODO", "severity": "low", "language": "python"}, {"id": "any", "pattern": "never"}]}')
    own = rules.load_rules(str(tmp_path / "r.json"))
    assert [(r.id, r.severity, r.languages) for r in own] == [("todo", "low", ("python",)), ("any", "medium", ())]
    (tmp_path / "bad.json").write_text('[{"id": "x", "pattern": "y", "severity": "awful"}]')
    with pytest.raises(ValueError):
        rules.load_rules(str(tmp_path / "bad.json"))
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("- id: todo\n  pattern: TODO\n  languages: [python]\n")
    assert rules.load_rules(str(tmp_path / "r.yaml"))[0].languages == ("python",)
    files = frame(spark, [("a.py", "python", "def f():\n    x = 1  # TODO\n    return eval(x)\nTODO = never"), ("b.go", "go", "TODO"), ("c.py", "python", None), ("d", None, "never")], "path string, language string, content string")
    assert rows(rules.findings(files, own).select("path", "line", "rule")) == {("a.py", 2, "todo"), ("a.py", 4, "todo"), ("a.py", 4, "any"), ("d", 1, "any")}
    assert rules.findings(files, own, "high").count() == 0
    around = rules.enclosing(rules.findings(files, [*own, *rules.LIBRARY]), extract.source_graph(files)[0])
    assert rows(around.select("line", "rule", "symbol").where("path = 'a.py'")) == {(2, "todo", "a.py::f#1"), (3, "dangerous-eval", "a.py::f#1"), (4, "todo", None), (4, "any", None)}


def test_filters_of_commands():
    from skarn.operators import compress

    assert compress.output("docker", "0123456789ab: Pulling fs layer\nStep 1/2 : FROM x\n ---> 123\nSuccessfully built") == "Step 1/2 : FROM x\nSuccessfully built"
    assert compress.output("aws", '{\n  "Name": "x",\n  "RequestId": "1"\n}') == '"Name": "x"'
    assert compress.output("files", "\n".join(f"src/a/f{i}.ts" for i in range(30)) + "\nlib/b/c.py") == "lib/b/ (1)\nsrc/a/ (30)"
    assert compress.output("github", "#1  fix\topen\n\nhttps://x\nShowing 1 of 9") == "#1  fix  open"
