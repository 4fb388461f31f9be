"""Readers of datasets, logs, source trees and developer files, as DataFrames.

Formats are chosen by extension. Text formats are read as strings (types are inferred by the profiler, not the reader);
readers that need an absent library say so instead of failing late.
"""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window


def csv(spark: SparkSession, path: str, sep: str = ",", max_rows: int | None = None) -> DataFrame:
    """Header row, doubled quotes, trimmed fields, short rows padded with null; every column text."""
    df = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("inferSchema", False).csv(path)
    return df.limit(max_rows) if max_rows else df


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, "\t")


def _as_text(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, other values as they are."""
    return df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{c}`") for c in df.columns])


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; malformed lines and lines that are no object are skipped."""
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^\{") & F.try_parse_json("value").isNotNull())
    sample = spark.read.option("mode", "DROPMALFORMED").json(path)
    names = [c for c in sample.columns if c != "_corrupt_record"]
    schema = T.StructType([sample.schema[c] for c in names])
    return _as_text(lines.select(F.from_json("value", schema).alias("r")).select("r.*"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one array of objects."""
    df = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return _as_text(df.drop("_corrupt_record"))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _needs(library: str, what: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, path: str) -> DataFrame:
        raise RuntimeError(f"{what} need the library {library}, which is not installed")

    return read


def excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet with a header row; dates as ISO text."""
    if importlib.util.find_spec("openpyxl") is None:
        return _needs("openpyxl", "spreadsheets")(spark, path)
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str))


def pdf(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page, content."""
    if importlib.util.find_spec("pypdf") is None:
        return _needs("pypdf", "PDF files")(spark, path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import pypdf

        for b in batches:
            rows = [(p, i + 1, x.extract_text() or "") for p, c in zip(*(b.column(i).to_pylist() for i in range(2))) for i, x in enumerate(pypdf.PdfReader(io.BytesIO(c)).pages)]
            yield pa.RecordBatch.from_pylist([{"path": a, "page": n, "content": t} for a, n, t in rows], pa.schema([("path", pa.string()), ("page", pa.int32()), ("content", pa.string())]))

    return files.mapInArrow(pages, "path string, page int, content string")


READERS: dict[str, tuple[Callable, str | None]] = {
    "csv": (csv, None), "tsv": (tsv, None), "jsonl": (jsonl, None), "ndjson": (jsonl, None), "json": (json_array, None), "parquet": (parquet, None), "xlsx": (excel, "openpyxl"), "xls": (excel, "openpyxl"), "pdf": (pdf, "pypdf"),
}


def formats() -> dict[str, bool]:
    """Extension to whether its reader can be used here."""
    return {k: lib is None or importlib.util.find_spec(lib) is not None for k, (_, lib) in READERS.items()}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A dataset of any known format."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(READERS)}")
    return READERS[kind][0](spark, path)


def dataset_id(path: str) -> str:
    """Slug of a path without its extension."""
    import re

    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", path.rpartition(".")[0].lower() or path.lower()))


# Extensions of languages.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "scala": "scala", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "ml": "ocaml", "lua": "lua", "r": "r",
    "jl": "julia", "sh": "bash", "bash": "bash", "sql": "sql", "vue": "vue", "svelte": "svelte", "sol": "solidity", "zig": "zig", "elm": "elm", "tf": "terraform", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "html": "html", "css": "css",
}


def language(path: F.Column) -> F.Column:
    """Language by extension, else unknown."""
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def discover(spark: SparkSession, path: str, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = (), marker: str | None = None) -> DataFrame:
    """Files below a folder by globs over their paths in it: (path, relative, size, modified). Nothing is read.

    marker: name of a file whose presence leaves out its folder with all below. Hidden files are left out by the reader.
    """
    from skarn.functions.text import glob_regex, path_prefixes

    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    root = re.sub("^file:/*", "/", path.rstrip("/"))
    every = every.withColumn("relative", F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(root)}/", ""))
    any_of = lambda globs: reduce(lambda a, b: a | b, [F.col("relative").rlike(glob_regex(g)) for g in globs], F.lit(False))
    found = every.where(any_of(include) & ~any_of(exclude))
    if marker is not None:
        folder = F.regexp_replace("relative", "/?[^/]*$", "")
        # Empty files aren't read, but they are listed: these are the names of the marker files only.
        marks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(path).inputFiles()
        gone = spark.createDataFrame([(re.sub("^file:/*", "/", m).removeprefix(f"{root}/").rpartition("/")[0],) for m in marks], "folder string")
        below = found.select("path", F.explode(F.concat(F.array(F.lit("")), path_prefixes(folder))).alias("folder")).join(gone, "folder", "left_semi").select("path")
        found = found.join(below, "path", "left_anti")
    return found.select("path", "relative", "size", "modified")


def nested_repositories(spark: SparkSession, path: str) -> DataFrame:
    """Folders below a root that are repositories of their own: (folder), by their HEAD file."""
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "HEAD").load(path).select("path")
    root = re.sub("^file:/*", "/", path.rstrip("/"))
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(root)}/", "")
    return heads.select(inside.alias("p")).where(F.col("p").rlike(r".+/\.git/HEAD$")).select(F.regexp_replace("p", r"/\.git/HEAD$", "").alias("folder"))


def source_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder: path, language, content, content_hash; symbolic links aren't followed by the reader."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.decode("content", "UTF-8")
    return f.select("path", language(F.col("path")).alias("language"), text.alias("content"), F.sha2("content", 256).alias("content_hash"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change) by content hash against an earlier listing: added, modified or removed."""
    both = files.select("path", F.col("content_hash").alias("new"), F.lit(None).cast("string").alias("old")).unionByName(known.select("path", F.lit(None).cast("string").alias("new"), F.col("content_hash").alias("old")))
    g = both.groupBy("path").agg(F.max("new").alias("new"), F.max("old").alias("old")).where("not (new <=> old)")
    return g.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified").alias("change"))


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python source by its own parser: (path, kind, name, qualified_name, start_line, end_line, docstring, calls)."""
    schema = "path string, kind string, name string, qualified_name string, start_line int, end_line int, docstring string, calls array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                stack = [(tree, "")]
                while stack:
                    node, owner = stack.pop()
                    for child in ast.iter_child_nodes(node):
                        inside = owner
                        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            inside = f"{owner}.{child.name}" if owner else child.name
                            kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                            calls = sorted({ast.unparse(c.func) for c in ast.walk(child) if isinstance(c, ast.Call)}) if kind != "class" else []
                            rows.append({"path": path, "kind": kind, "name": child.name, "qualified_name": inside, "start_line": child.lineno, "end_line": child.end_lineno, "docstring": ast.get_docstring(child), "calls": calls})
                        stack.append((child, inside))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("calls", pa.list_(pa.string()))]))

    return files.where("language = 'python'").select("path", "content").mapInArrow(run, schema)


def notebook_code(files: DataFrame) -> DataFrame:
    """Code cells of notebooks in order: (path, cell, source)."""
    cell = "array<struct<cell_type string, source string>>"
    cells = F.from_json("content", f"struct<cells: {cell}>")
    lines = "array<struct<cell_type string, source array<string>>>"
    as_lists = F.from_json("content", f"struct<cells: {lines}>")
    own = F.posexplode(F.col("l.cells")).alias("cell", "c")
    return files.select("path", cells.alias("t"), as_lists.alias("l")).select("path", own).where("c.cell_type = 'code'").select("path", "cell", F.array_join("c.source", "").alias("source"))


# -- developer files ------------------------------------------------------------------------------------------------
def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole files with their numbers: (path, line_no, line)."""
    t = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def lcov(lines: DataFrame) -> DataFrame:
    """Covered and total lines per file of (path, line_no, line) rows of coverage records."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    file = F.last(F.nullif(F.regexp_extract("line", r"^SF:(.*?)\s*$", 1), F.lit("")), ignorenulls=True).over(w)
    hits = F.nullif(F.regexp_extract("line", r"^DA:\d+,(\d+)", 1), F.lit("")).cast("bigint")
    return lines.withColumn("file", file).withColumn("hits", hits).where("hits is not null").groupBy("file").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count(F.lit(1)).alias("total"))


def unified_diff(lines: DataFrame) -> DataFrame:
    """Hunks of (path, line_no, line) rows: (file, old_start, old_lines, new_start, new_lines). A hunk without new lines only
    deletes, one without old lines only adds; of a deleted file the old name counts."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lambda sign, side: F.last(F.nullif(F.regexp_extract("line", rf"^{sign * 3} (?:{side}/)?(.*?)\s*$", 1), F.lit("")), ignorenulls=True).over(w)
    at = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    h = lines.select("*", named("-", "a").alias("old_file"), named("\\+", "b").alias("new_file")).where(F.col("line").rlike(at))
    part = lambda i: F.regexp_extract("line", at, i)
    length = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(1))
    file = F.when(F.col("new_file") == "/dev/null", F.col("old_file")).otherwise(F.col("new_file"))
    return h.select(file.alias("file"), part(1).cast("int").alias("old_start"), length(2).alias("old_lines"), part(3).cast("int").alias("new_start"), length(4).alias("new_lines"))


def istanbul(files: DataFrame) -> DataFrame:
    """Covered and total statements per file of (path, content) coverage reports in JSON; broken reports have none."""
    e = files.select(F.explode(F.from_json("content", "map<string, struct<s: map<string, bigint>>>")).alias("file", "r")).where("r.s is not null")
    hits = F.map_values("r.s")
    g = e.select("file", F.size(F.filter(hits, lambda h: h > 0)).cast("bigint").alias("covered"), F.size(hits).cast("bigint").alias("total"))
    return g.groupBy("file").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))


def git_log(lines: DataFrame, separator: str = "|||") -> DataFrame:
    """Commits of lines with five fields: hash, author, email, date, subject."""
    f = F.split("line", f"\\Q{separator}\\E")
    return lines.where(F.size(f) >= 5).select(*[f[i].alias(n) for i, n in enumerate(("hash", "author", "email", "date", "subject"))])


def npm_lock(files: DataFrame) -> DataFrame:
    """(parent, child) pairs of a lock file (path, content) whose packages map paths to dependencies."""
    p = "struct<packages: map<string, struct<version string, dependencies: map<string, string>>>>"
    e = files.select(F.explode(F.from_json("content", p).packages).alias("at", "p")).select(F.regexp_extract("at", r"([^/]+|@[^/]+/[^/]+)$", 1).alias("parent"), F.explode("p.dependencies").alias("child", "range"))
    return e.select("parent", "child").distinct().unionByName(_npm_tree(files)).distinct()


def _npm_tree(files: DataFrame) -> DataFrame:
    """(parent, child) pairs of the older form, in which packages hold their own dependencies to any depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            pairs = []
            for text in b.column(0).to_pylist():
                try:
                    stack = [json.loads(text or "")]
                except ValueError:
                    continue
                while stack:
                    at = stack.pop()
                    for name, p in (at.get("dependencies") or {}).items() if isinstance(at, dict) else ():
                        if isinstance(p, dict):
                            wanted = p.get("requires") if isinstance(p.get("requires"), dict) else {}
                            pairs += [(name, c) for c in {*wanted, *(p.get("dependencies") or {})}]
                            stack.append(p)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([c for _, c in pairs], pa.string())], ["parent", "child"])

    return files.select("content").mapInArrow(run, "parent string, child string")


def dependencies(files: DataFrame) -> DataFrame:
    """Declared dependencies of manifests (path, content): (ecosystem, name, constraint, scope, manifest)."""
    npm = files.where(F.col("path").endswith("package.json")).select("path", F.from_json("content", "struct<dependencies: map<string, string>, devDependencies: map<string, string>>").alias("j"))
    parts = [npm.select(F.lit("npm").alias("ecosystem"), F.explode(f"j.{k}").alias("name", "constraint"), F.lit(s).alias("scope"), F.col("path").alias("manifest")) for k, s in (("dependencies", "production"), ("devDependencies", "development"))]
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line"))
    pip = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>~!]=?=?\s*[^;#\s,]+,?\s*)*)"
    py = lines.where(F.col("path").rlike(r"requirements[^/]*\.txt$") & ~F.col("line").rlike(r"^\s*(#|-|$)"))
    parts.append(py.select(F.lit("pip").alias("ecosystem"), F.regexp_extract("line", pip, 1).alias("name"), F.trim(F.regexp_extract("line", pip, 2)).alias("constraint"), F.lit("production").alias("scope"), F.col("path").alias("manifest")).where("name <> ''"))
    go = r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)"
    parts.append(lines.where(F.col("path").endswith("go.mod") & F.col("line").rlike(go)).select(F.lit("go").alias("ecosystem"), F.regexp_extract("line", go, 1).alias("name"), F.regexp_extract("line", go, 2).alias("constraint"), F.lit("production").alias("scope"), F.col("path").alias("manifest")))
    cargo = r"^\s*([\w-]+)\s*=\s*(?:\"([^\"]+)\"|\{[^}]*version\s*=\s*\"([^\"]+)\")"
    parts.append(lines.where(F.col("path").endswith("Cargo.toml") & F.col("line").rlike(cargo) & ~F.col("line").rlike(r"^\s*(name|version|edition|license|description|authors)\s*=")).select(F.lit("cargo").alias("ecosystem"), F.regexp_extract("line", cargo, 1).alias("name"), F.concat(F.regexp_extract("line", cargo, 2), F.regexp_extract("line", cargo, 3)).alias("constraint"), F.lit("production").alias("scope"), F.col("path").alias("manifest")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
