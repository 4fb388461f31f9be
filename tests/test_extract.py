from skarn.operators import resolve
from skarn.sources import extract, formats

FILES = [
    ("src/a.ts", "typescript", "import { B } from './b'\nexport class A extends Base implements Face, Other {\n  async run(id: string): Promise<void> {\n    if (id) { helper(id) }\n    this.store.save(id) // not(called)\n  }\n}\nfunction helper(x) {\n  return B.make('call(me)')\n}\n"),
    ("src/b.ts", "typescript", "export class B {\n  make(x) {\n  }\n}\nexport interface Face {\n}\n"),
    ("lib/c.py", "python", "from lib.d import thing\n\nclass C(Base, metaclass=M):\n    def go(self):\n        thing(self)\n\n        return helper(1)  # no(call)\n\ndef outer():\n    def inner():\n        pass\n    inner()\n"),
    ("lib/d.py", "python", "def thing(x):\n    return x\nclass Base:\n    pass\n"), ("e.rs", "rust", "pub trait Shape {\n}\npub struct Dot {\n}\nimpl Shape for Dot {\n    fn area(&self) -> f64 {\n        compute::area(self)\n    }\n}\n"),
    ("f.go", "go", None), ("g.txt", "text", "def no(): pass"), (None, "go", "func X() {}"),
]


def test_graph_of_source(spark):
    files = spark.createDataFrame([(*f, "x") for f in FILES + FILES[:1]], "path string, language string, content string, name string")
    nodes, edges, failed = extract.resolved_graph(files)
    n = {r.qualified_name: r for r in nodes.collect()}
    assert {q: (r.kind, r.start_line, r.end_line, r.is_exported) for q, r in n.items() if r.kind != "file"} == {
        "src/a.ts::A": ("class", 2, 7, True), "src/a.ts::A.run": ("method", 3, 6, False), "src/a.ts::helper": ("function", 8, 10, False), "src/b.ts::B": ("class", 1, 4, True), "src/b.ts::B.make": ("method", 2, 3, False), "src/b.ts::Face": ("interface", 5, 6, True),
        "lib/c.py::C": ("class", 3, 7, True), "lib/c.py::C.go": ("method", 4, 7, True), "lib/c.py::outer": ("function", 9, 12, True), "lib/c.py::outer.inner": ("function", 10, 11, True), "lib/d.py::thing": ("function", 1, 2, True), "lib/d.py::Base": ("class", 3, 4, True),
        "e.rs::Shape": ("trait", 1, 2, True), "e.rs::Dot": ("struct", 3, 4, True), "e.rs::area": ("function", 6, 8, False),
    }
    assert {q for q, r in n.items() if r.kind == "file"} == {"src/a.ts", "src/b.ts", "lib/c.py", "lib/d.py", "e.rs", "f.go"}
    name = {r.id: r.qualified_name for r in n.values()}
    got = {(name[r.source].split("::")[-1], name[r.target].split("::")[-1], r.kind) for r in edges.collect()}
    assert got - {g for g in got if g[2] == "contains"} == {
        ("src/a.ts", "src/b.ts", "imports"), ("A", "Base", "extends"), ("A", "Face", "implements"), ("C", "Base", "extends"), ("A.run", "helper", "calls"), ("helper", "B.make", "calls"), ("C.go", "thing", "calls"), ("C.go", "helper", "calls"), ("outer", "outer.inner", "calls"),
        ("e.rs", "Shape", "implements"), ("area", "area", "calls"),
    }
    assert {("A", "A.run"), ("src/a.ts", "A"), ("outer", "outer.inner")} <= {g[:2] for g in got if g[2] == "contains"}
    assert {(r.ref_name, r.kind, tuple(r.attempted)) for r in failed.collect()} == {("Other", "implements", ("type-name",)), ("this.store.save", "calls", ("qualified", "suffix", "exact", "lower")), ("lib.d", "imports", ("import-path",))}


def test_empty_sources(spark):
    files = spark.createDataFrame([], "path string, language string, content string")
    assert [x.count() for x in extract.resolved_graph(files)] == [0, 0, 0]


def test_ways_of_imports(spark):
    nodes = [("1", "class", "Foo", "com.ex.Foo", "Foo.java"), ("2", "method", "bar", "com.ex.Foo.bar", "Foo.java"), ("3", "namespace", "My.App", "My.App", "x.cs"), ("4", "class", "Svc", "My.App.Svc", "x.cs"), ("5", "function", "f", "src/u/index.tsx::f", "src/u/index.tsx"), ("0", "class", "Foo", "org.other.Foo", "o.java"), (None, "class", "N", "com.N", "n")]
    n = spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string")
    specs = ["com.ex.Foo", "com.ex.*", "com.ex.deep.Foo", "My.App", "My", "./u", "../src/u/index.tsx", "none", "org.Foo", "com.N", None]
    i = spark.createDataFrame([("src/a.ts", s) for s in specs], "from_file string, spec string")
    got = {r.spec: (r.node_id, r.strategy) for r in resolve.resolve_specs(i, n).collect()}
    assert got == {
        "com.ex.Foo": ("1", "qualified"), "com.ex.*": ("1", "wildcard"), "My.App": ("3", "qualified"), "My": ("3", "prefix"), "./u": ("5", "import-path"), "../src/u/index.tsx": ("5", "import-path"), "org.Foo": ("0", "name in namespace"),
    }


def test_fences_are_files(spark):
    text = "a\n```py x=1\ndef f():\n    pass\n```\n  ~~~ts\nfunction g() {\n```\n}\n  ~~~\n```json\n{}\n```\n```go\nfunc H() {}"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, t string")
    got = {r.path: (r.language, r.content) for r in formats.code_fences(docs, "id", "t").collect()}
    assert got == {"1/0": ("python", "def f():\n    pass"), "1/1": ("typescript", "function g() {\n```\n}"), "1/3": ("go", "func H() {}")}
