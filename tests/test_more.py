import numpy as np
import pytest

from skarn.functions import text
from skarn.operators import compress, documents, graph, memory, quantized, security
from skarn.sources import formats, sinks
from skarn.streaming import windows


def test_quantised_index(spark):
    x = [[float(np.sin(0.3 * i + 0.1 * j)) for j in range(64)] for i in range(20)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(99, None), (98, [0.0] * 64), (97, [1.0])], "id int, v array<double>")
    index = quantized.encode(df, "id", "v", 64, 4)
    assert index.count() == 20 and index.selectExpr("max(length(code)) n").first().n == 32
    assert [r.id for r in quantized.search(index, x[5], 1, 4).collect()] == [5]
    assert {r.id for r in quantized.search(index, x[5], 3, 4).collect()} == {4, 5, 6}
    fewer = quantized.remove(index, spark.createDataFrame([(5,)], "id int"))
    assert fewer.count() == 19 and quantized.add(fewer, index.where("id = 5")).count() == 20
    with pytest.raises(ValueError):
        quantized.encode(df, "id", "v", 64, 9)


@pytest.mark.parametrize("bits,least", [(1, 0.3), (2, 0.5), (4, 0.75), (8, 0.95)])
def test_quantised_recall(spark, bits, least):
    rng = np.random.default_rng(bits)
    x = rng.standard_normal((600, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    index = quantized.encode(df, "id", "v", 48, bits).cache()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(5):
        got = {r.id for r in quantized.search(index, x[q].tolist(), 10, bits).collect()}
        hits.append(len(got & set(np.argsort(-(u @ u[q]))[:10].tolist())) / 10)
    assert np.mean(hits) >= least


def test_levels_are_lloyd_max():
    assert np.allclose(quantized.levels(1), [-0.7979, 0.7979], atol=2e-3)
    assert np.allclose(quantized.levels(2), [-1.5104, -0.4528, 0.4528, 1.5104], atol=5e-3)


def test_sections_of_formats(spark):
    docs = {
        "asciidoc": "= A\ntext\n== B\n=== C\n== D\n", "org": "* A\n** TODO B :tag:\n*** C\n** D\n", "rst": "A\n=\n\n", "html": "<h1>A</h1><p>x</p><h2 class='q'>B <b>c</b></h2>", "text": "ALL CAPS\nbody\n\nNEXT PART\nbody",
    }
    for kind, want in (("asciidoc", [("A", 1, []), ("B", 2, ["A"]), ("C", 3, ["A", "B"]), ("D", 2, ["A"])]), ("org", [("A", 1, []), ("B", 2, ["A"]), ("C", 3, ["A", "B"]), ("D", 2, ["A"])]), ("html", [("A", 1, []), ("B c", 2, ["A"])]), ("text", [("ALL CAPS", 1, []), ("NEXT PART", 1, [])])):
        df = spark.createDataFrame([("d", docs[kind]), ("n", None), ("e", "")], "id string, t string")
        got = [(r.title, r.level, list(r.ancestors)) for r in formats.sections(df, "id", "t", kind).orderBy("position").collect()]
        assert got == want, kind
    rst = spark.createDataFrame([("d", "Top\n===\n\nSub é\n-----\ntext\n\nNext\n====\n")], "id string, t string")
    rows = formats.sections(rst, "id", "t", "rst").orderBy("position").collect()
    assert [(r.title, r.level) for r in rows] == [("Top", 1), ("Sub é", 2), ("Next", 1)] and rows[0].byte_end == rows[1].byte_start
    md = spark.createDataFrame([("d", "# A\n```\n# no\n```\n## B\nSet\n---\n# C")], "id string, t string")
    assert [(r.title, r.level, list(r.ancestors)) for r in documents.markdown_sections(md, "id", "t").orderBy("position").collect()] == [("A", 1, []), ("B", 2, ["A"]), ("Set", 2, ["A"]), ("C", 1, [])]


def test_declarations_routes_manifests(spark):
    f = spark.createDataFrame([("a.ts", "typescript", "export class A {}\nimport x from './y'\nasync function go() {}\napp.get('/u/:id', h)"), ("b.go", "go", "type S struct {\nfunc (s *S) Run() {"), ("c.rs", "rust", "pub fn run() {}\nuse a::b;")], "path string, language string, content string")
    got = {(r.path, r.kind, r.name) for r in formats.declared_symbols(f).collect()}
    assert got == {("a.ts", "class", "A"), ("a.ts", "import", "./y"), ("a.ts", "function", "go"), ("b.go", "struct", "S"), ("b.go", "function", "Run"), ("c.rs", "function", "run"), ("c.rs", "import", "a::b")}
    assert [tuple(r) for r in formats.routes(f).collect()] == [("a.ts", "express", "get", "/u/:id")]
    m = spark.createDataFrame([("Gemfile", "gem 'rails', '~> 7'\n"), ("x.csproj", '<PackageReference Include="N.J" Version="13.0.1" />'), ("pom.xml", "<dependency>\n<groupId>g</groupId><artifactId>a</artifactId>\n<version>1</version></dependency>"), ("composer.json", '{"require": {"php": "8", "m/l": "^2"}}'), ("Cargo.lock", '[[package]]\nname = "a"\ndependencies = [\n "b",\n "c 1.0",\n]\n\n[[package]]\nname = "b"\n')], "path string, content string")
    assert {(r.ecosystem, r.name, r.constraint) for r in formats.more_dependencies(m).collect()} == {("rubygems", "rails", "~> 7"), ("nuget", "N.J", "13.0.1"), ("maven", "g:a", "1"), ("composer", "m/l", "^2")}
    assert {tuple(r) for r in formats.cargo_lock(m).collect()} == {("a", "b"), ("a", "c")}


def test_compression():
    t = "Please note that the function `the_code()` is actually very slow at https://a.b/the/x v1.2.3 in order to work."
    s = compress.shorten(t, "full")
    assert "`the_code()`" in s and "https://a.b/the/x" in s and "v1.2.3" in s and "actually" not in s and len(s) < len(t)
    with pytest.raises(ValueError):
        compress.shorten("x", "most")
    assert compress.generic(["a 1", "a 2", "a 3", "", "b"]) == ["a 1", "  ... similar lines", "b"]
    assert compress.output("test", "ok\nFAILED x\n3 passed") == "FAILED x\n3 passed"
    assert compress.cut_repeats("A. A. A. A. B.", 2) == "A. A."


def test_sections_context_pages_and_edits(spark):
    s = spark.createDataFrame([("r", None, "Root", 1), ("a", "r", "A", 1), ("b", "a", "B", 1)], "id string, parent_id string, title string, updated_at bigint")
    got = {r.id: (r.ancestors, r.children) for r in documents.section_context(s).collect()}
    assert got == {"r": ("", 1), "a": ("Root", 1), "b": ("Root > A", 0)}
    pages = spark.createDataFrame([("p", "old"), ("q", "keep")], "slug string, content string")
    blocks = spark.createDataFrame([("p", 2, "append", "more"), ("p", 1, "replace", "new"), ("n", 1, "append", "first")], "slug string, seq bigint, action string, body string")
    assert {tuple(r) for r in documents.apply_blocks(pages, blocks).collect()} == {("p", "new\n\nmore"), ("q", "keep"), ("n", "first")}
    d = spark.createDataFrame([("a\nb\nc", "aXb")], "t string, u string")
    r = d.select(text.insert_at(d.t, 2, "x").alias("i"), text.line_range(d.t, 2, 3).alias("l"), text.replace_once(d.u, d.u.substr(2, 1), d.u.substr(1, 1)).alias("o")).first()
    assert (r.i, r.l, r.o) == ("a\nx\nb\nc", "b\nc", "aab")


def test_memory_and_security_helpers(spark):
    assert memory.duration_ms("2h") == 7_200_000 and memory.duration_ms("") == 90 * 86_400_000
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["## Decisions", "- use cache", "- no", "## Other", "- ignored text"])], "doc_id string, line_no int, line string")
    assert [(r.kind, r.bullet) for r in memory.capture(lines, {"Decisions": "decision"}).collect()] == [("decision", "use cache")]
    f = spark.createDataFrame([("c1", "affected"), ("c1", "not_affected"), ("c2", None)], "cve string, verdict string")
    assert {tuple(r) for r in security.worst_verdict(f, ["cve"]).collect()} == {("c1", "affected", 2), ("c2", None, 1)}
    n = spark.createDataFrame([("lodahs",), ("lodash",), ("react",)], "name string")
    assert [tuple(r) for r in security.lookalikes(n, ["lodash"]).collect()] == [("lodahs", "lodash", 2)]
    k = spark.createDataFrame([("d", "password = 'hunter2hunter2'"), ("e", None), ("f", "fine")], "id string, t string")
    assert [r.rule for r in security.secrets(k, "id", "t").collect()] == ["assignment"]


def test_labels(spark, tmp_path):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    sinks.save_label(a, f"{tmp_path}/s", "main")
    sinks.save_label(a.limit(1), f"{tmp_path}/s", "next")
    sinks.save_label(a, f"{tmp_path}/s", "next")
    assert sinks.labels(spark, f"{tmp_path}/s") == ["main", "next"] and spark.read.parquet(f"{tmp_path}/s").count() == 4


def test_walk_in_order(spark):
    e = spark.createDataFrame([("a", "c", "calls"), ("a", "b", "calls"), ("b", "d", "calls"), ("d", "a", "calls")], "source string, target string, kind string")
    assert [r.id for r in graph.dfs_order(e, "a").orderBy("position").collect()] == ["a", "b", "d", "c"]
    with pytest.raises(ValueError):
        graph.dfs_order(e, "a", limit=2)


def test_walk_in_order_of_any_size(spark):
    import random

    def walk(edges, start, depth):
        below = {}
        for s, t in sorted(set(edges)):
            below.setdefault(s, []).append(t)
        out, stack = [], [(start, 0)]
        while stack:
            at, d = stack.pop()
            if at not in out:
                out.append(at)
                stack += [(t, d + 1) for t in reversed(below.get(at, []))] if d < depth else []
        return out

    tree = [("r", f"n{i}") for i in range(30)] + [(f"n{i}", f"m{i}-{j}") for i in range(30) for j in range(50)]
    e = spark.createDataFrame([(s, t, "contains") for s, t in tree], "source string, target string, kind string")
    assert [r.id for r in graph.dfs_order(e, "r").orderBy("position").collect()] == walk(tree, "r", 10)
    rng = random.Random(3)
    mixed = [(f"x{rng.randrange(9)}", f"x{rng.randrange(9)}") for _ in range(20)] + [("s", "a"), ("a", "b"), ("s", "b"), ("b", "c"), ("c", "s"), ("s", "x1")]
    e = spark.createDataFrame([(s, t, "calls") for s, t in mixed], "source string, target string, kind string")
    for depth in (2, 4, 20):
        got = graph.dfs_order(e, "s", depth).orderBy("position").collect()
        assert [r.id for r in got] == walk(mixed, "s", depth) and [r.position for r in got] == list(range(len(got)))


def test_contradictions_pair_by_pair(spark, monkeypatch):
    import re

    rng = np.random.default_rng(5)
    say = ["not so", "superseded now", "deprecated, not good", "fine", "instead of all", ""]
    pages = [(f"p{i}", f"page t{rng.integers(3)}" if i % 5 else ["t1", "", None, "zzz t2"][i // 5 % 4], f"{say[rng.integers(6)]} t{rng.integers(3)} page") for i in range(60)]
    pages += [("p3", "t0", "deprecated t1 page"), ("p3", "t1", "not t0"), ("p4", "t1", "instead of not t0"), pages[7], (None, "t1", "not t1")]
    want = {}
    for sa, ta, ca in pages:
        for sb, tb, cb in pages:
            ask, has = set(re.findall(r"\w+", ta or "")), set(re.findall(r"\w+", f"{tb or ''} {cb}"))
            marks = [m for m in documents.NEGATIONS if m in ca and m in cb]
            if sa and sb and sa != sb and ask and ask <= has and marks:
                k = (min(sa, sb), max(sa, sb))
                want[k] = min(want.get(k, marks[0]), marks[0])
    monkeypatch.setattr(documents, "CLASS_BLOCK", 2, raising=False)
    df = spark.createDataFrame(pages, "slug string, title string, content string")
    got = documents.contradictions(df)
    assert sorted(map(tuple, got.collect())) == sorted((*k, v) for k, v in want.items()) and want
    # What makes the pairs comes last: they are not gathered again.
    once = documents.contradictions(df.dropDuplicates(["slug"]))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.partition("Generate")[0]


def test_sessions_of_stream_and_table_agree(spark):
    rows = [(1, t) for t in (0, 3600, 7200, 7201, 20000, 27200)] + [(2, 5), (2, 5)] + [(None, 1)]
    df = spark.createDataFrame([(u, t) for u, t in rows], "user_id bigint, s bigint").selectExpr("user_id", "timestamp_seconds(s) ts")
    got = sorted((r.user_id, int(r.session_start.timestamp()), r.n) for r in windows.started_sessions_batch(df).collect())
    assert [(u, n) for u, _, n in got] == [(1, 3), (1, 1), (1, 2), (2, 2)]


def test_rows_that_come_late_are_dropped(spark, tmp_path):
    def put(name, *seconds):
        spark.createDataFrame([(s,) for s in seconds], "s bigint").selectExpr("timestamp_seconds(s) ts", "'x' event_type", "1.0D value").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    put("a", 10, 100_000_000)
    put("b", 20)  # the watermark filters from the batch after next
    put("c", 30)
    schema = spark.read.parquet(f"{tmp_path}/in/a").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = windows.drain(windows.tumbling(stream, width="1 hour", late="1 hour"), "update")
    assert out.agg({"n": "max"}).first()[0] == 2
