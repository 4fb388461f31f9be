import pytest

from skarn.functions import text
from skarn.operators import resolve, search
from skarn.sources import readers, sinks


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    c = readers.read(spark, write(tmp_path / "a.csv", 'id,name\n1, "x ""y""" \n\n2\n'))
    assert [tuple(r) for r in c.collect()] == [("1", 'x "y"'), ("2", None)]
    assert readers.read(spark, write(tmp_path / "a.tsv", "id\tv\n1\tq\n")).first().v == "q"
    j = readers.read(spark, write(tmp_path / "a.jsonl", '{"a": 1}\nnot json\n[1]\n{"b": {"c": 2}, "a": 3}\n'))
    assert sorted((r.a, r.b) for r in j.collect() if r.b) == [(3, '{"c":2}')] and j.count() == 2
    assert readers.read(spark, write(tmp_path / "a.json", '[{"k": "v"}, {"k": "w"}]')).count() == 2
    with pytest.raises(ValueError):
        readers.read(spark, "x.unknown")
    assert set(readers.formats()) >= {"csv", "parquet", "xlsx"}
    assert readers.dataset_id("data/My File.csv") == "data-my-file"


def test_source_tree_and_python_symbols(spark, tmp_path):
    (tmp_path / "p").mkdir()
    write(tmp_path / "p" / "m.py", 'class A:\n    def f(self):\n        """Doc."""\n        return g()\n\ndef g():\n    pass\n')
    write(tmp_path / "p" / "bad.py", "def (:\n")
    tree = readers.source_tree(spark, str(tmp_path / "p"))
    got = {r.qualified_name: (r.kind, r.start_line, list(r.calls)) for r in readers.python_symbols(tree).collect()}
    assert got == {"A": ("class", 1, []), "A.f": ("method", 2, ["g"]), "g": ("function", 6, [])}
    known = tree.where("path like '%m.py'").selectExpr("path", "'old' content_hash")
    assert sorted(r.change for r in readers.changed(tree, known).collect()) == ["added", "modified"]


def test_developer_files(spark, tmp_path):
    lines = readers.numbered(spark, write(tmp_path / "l.info", "SF:a.ts\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.ts\nDA:1,1\n"))
    assert {tuple(r) for r in readers.lcov(lines).collect()} == {("a.ts", 1, 2), ("b.ts", 1, 1)}
    d = readers.numbered(spark, write(tmp_path / "d.diff", "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@\n+q\n@@ -9 +12 @@\n--- a/gone.py\n+++ /dev/null\n@@ -1,5 +0,0 @@\n-x\n"))
    assert {tuple(r) for r in readers.unified_diff(d).collect()} == {("x.py", 1, 2, 3, 4), ("x.py", 9, 1, 12, 1), ("gone.py", 1, 5, 0, 0)}
    cov = spark.createDataFrame([("c", '{"a.ts": {"s": {"0": 2, "1": 0}}, "b.ts": {"s": {}}, "c.ts": {"f": {}}}'), ("d", "broken"), ("e", None)], "path string, content string")
    assert {tuple(r) for r in readers.istanbul(cov).collect()} == {("a.ts", 1, 2), ("b.ts", 0, 0)}
    lock = spark.createDataFrame([("l", '{"dependencies": {"a": {"version": "1", "requires": {"b": "^1"}, "dependencies": {"c": {"requires": {"d": "1"}}}}, "b": {}}}'), ("m", '{"packages": {"": {"dependencies": {"x": "1"}}, "node_modules/x": {"dependencies": {"y": "1"}}}}'), ("n", "{"), ("o", None)], "path string, content string")
    assert {tuple(r) for r in readers.npm_lock(lock).collect()} >= {("a", "b"), ("a", "c"), ("c", "d"), ("x", "y")}
    g = spark.createDataFrame([("h|||a|||e|||d|||fix: x",), ("short",)], "line string")
    assert readers.git_log(g).first().subject == "fix: x"
    m = spark.createDataFrame([("package.json", '{"dependencies": {"express": "^4.18.2"}, "devDependencies": {"jest": "^29"}}'), ("requirements.txt", "requests==2.31.0\n# c\nflask>=3\n"), ("go.mod", "require github.com/google/uuid v1.4.0\n"), ("Cargo.toml", '[dependencies]\nserde = "1.0"\ntokio = { version = "1", features = [] }\n')], "path string, content string")
    got = {(r.ecosystem, r.name, r.constraint, r.scope) for r in readers.dependencies(m).collect()}
    assert got == {("npm", "express", "^4.18.2", "production"), ("npm", "jest", "^29", "development"), ("pip", "requests", "==2.31.0", "production"), ("pip", "flask", ">=3", "production"), ("go", "github.com/google/uuid", "v1.4.0", "production"), ("cargo", "serde", "1.0", "production"), ("cargo", "tokio", "1", "production")}


def test_delete_by_file_and_exports(spark):
    n = spark.createDataFrame([("a", "class", "f1"), ("b<", "class", "f2")], "id string, kind string, file_path string")
    e = spark.createDataFrame([("a", "b<", "calls"), ("b<", "b<", "calls")], "source string, target string, kind string")
    n2, e2 = sinks.delete_by_file(n, e, spark.createDataFrame([("f1",)], "file_path string"))
    assert n2.count() == 1 and [tuple(r) for r in e2.collect()] == [("b<", "b<", "calls")]
    assert any("b&lt;" in r.value for r in sinks.graphml(n, e).collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("fetchHTTPCache_keyV2",)], "s string")
    assert df.select(text.split_camel(df.s).alias("w")).first().w == ["fetch", "http", "cache", "key", "v2"]
    v = spark.createDataFrame([("1.10.0",), ("1.9.3",), ("2.0.0-rc1",), ("2.0.0",)], "v string")
    assert [r.v for r in v.orderBy(text.version_key(v.v)).collect()] == ["1.9.3", "1.10.0", "2.0.0-rc1", "2.0.0"]
    p = spark.createDataFrame([("a/./b/../c//d",)], "p string")
    assert p.select(text.normalise_path(p.p).alias("x")).first().x == "a/c/d"
    b = spark.createDataFrame([("{ { } {{}} }",)], "s string")
    assert b.select(text.nesting_depth(b.s).alias("d")).first().d == 3


def test_search_and_resolution(spark):
    docs = spark.createDataFrame([(1, "JWT token auth token"), (2, "token"), (3, None), (4, "")], "id int, t string")
    assert [r.doc for r in search.bm25(docs, "id", "t", "auth tok").collect()] == [1]
    assert search.bm25(docs, "id", "t", "AND").count() == 0
    import math

    vecs = spark.createDataFrame([(i, [math.sin(0.3 * i + 0.1 * j) for j in range(64)]) for i in range(20)], "id int, v array<double>")
    q = [math.sin(1.5 + 0.1 * j) for j in range(64)]
    assert [r.id for r in search.nearest(vecs, "id", "v", q, 4).collect()] == [5, 6, 4, 7]
    nodes = spark.createDataFrame([("1", "Foo", "m.Foo", "class"), ("2", "foo", "m.foo", "function"), ("3", "bar", "m.Foo.bar", "method")], "id string, name string, qualified_name string, kind string")
    refs = spark.createDataFrame([("m.Foo",), ("x.bar",), ("BAR",), ("nothing",), (None,)], "ref_name string")
    got = {r.ref_name: (r.node_id, r.strategy) for r in resolve.resolve_names(refs, nodes).collect()}
    assert got == {"m.Foo": ("1", "qualified"), "x.bar": ("3", "suffix"), "BAR": ("3", "lower")}


def test_interface_descriptions(spark):
    from skarn.sources import formats

    docs = [(1, '{"openapi": "3.0", "info": {"title": "Shop"}, "paths": {"/a": {"get": {"summary": "List"}, "post": {"operationId": "make"}, "parameters": []}, "/b": {}}}'), (2, '{"paths": {"/x": {}}}'), (3, "no json"), (4, None), (5, '{"swagger": "2.0"}')]
    got = {tuple(r) for r in formats.openapi_sections(spark.createDataFrame(docs, "id int, t string"), "id", "t").collect()}
    assert got == {("1", 1, "Shop", None, None, None), ("1", 2, "/a", "/a", None, None), ("1", 2, "/b", "/b", None, None), ("1", 3, "GET /a", "/a", "get", "List"), ("1", 3, "POST /a", "/a", "post", "make"), ("5", 1, "API", None, None, None)}


def test_discovery(spark, tmp_path):
    for p in ("a/x.csv", "a/y.json", "b/deep/z.csv", "skip/no.csv", "skip/in/no.csv", "gen/g.csv"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        write(tmp_path / p, "1")
    write(tmp_path / "skip" / "noindex", "")
    got = {r.relative for r in readers.discover(spark, str(tmp_path), ("**/*.csv",), ("gen/**",), "noindex").collect()}
    assert got == {"a/x.csv", "b/deep/z.csv"}
    (tmp_path / "b" / ".git").mkdir()
    write(tmp_path / "b" / ".git" / "HEAD", "ref")


def test_tables_replace_themselves(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2] and [x.name for x in tmp_path.iterdir()] == ["t"]
