"""Sections of document formats, symbols and routes of source text by patterns, more manifests, rules over lines."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SECTIONS = "doc_id string, position int, level int, title string, ancestors array<string>, byte_start bigint, byte_end bigint"
_FIELDS = [("doc_id", pa.string()), ("position", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("ancestors", pa.list_(pa.string())), ("byte_start", pa.int64()), ("byte_end", pa.int64())]


def _marked(pattern: str) -> "re.Pattern":
    return re.compile(pattern, re.M)


def headings(text: str, kind: str) -> Iterator[tuple[int, int, str]]:
    """(character offset, level, title) of the headings of a text in a format."""
    if kind in ("asciidoc", "rdoc"):
        for m in _marked(r"^(={1,6})[ \t]+(\S.*?)[ \t]*=*[ \t]*$").finditer(text):
            yield m.start(), len(m[1]), m[2]
    elif kind == "org":
        for m in _marked(r"^(\*{1,8})[ \t]+(?:(?:TODO|DONE)[ \t]+)?(\S.*?)(?:[ \t]+:[\w:]+:)?[ \t]*$").finditer(text):
            yield m.start(), len(m[1]), m[2]
    elif kind == "rst":
        seen: list[str] = []
        for m in _marked(r"^(\S[^\n]*)\n([=\-~^\"'`#*+.:_])\2{2,}[ \t]*$").finditer(text):
            if len(m[0]) - len(m[1]) - 1 >= len(m[1].rstrip()):
                if m[2] not in seen:
                    seen.append(m[2])
                yield m.start(), seen.index(m[2]) + 1, m[1].strip()
    elif kind == "html":
        found = False
        for m in re.finditer(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", text, re.I | re.S):
            found = True
            yield m.start(), int(m[1]), re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", m[2])).strip()
        if not found and (m := re.search(r"<title[^>]*>(.*?)</title>", text, re.I | re.S)):
            yield m.start(), 1, m[1].strip()
    elif kind == "text":
        for m in _marked(r"(?:\A|(?<=\n\n))([A-Z][A-Z0-9 ,'/&-]{2,60})$").finditer(text):
            yield m.start(), 1, m[1].strip()
    else:
        raise ValueError(f"unknown document format {kind!r}")


def sections(docs: DataFrame, id: str, text: str, kind: str) -> DataFrame:
    """Sections with byte ranges; a section's parent is the nearest one before it of a lower level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(headings(t, kind)) if t else []
                stack: list[tuple[int, str]] = []
                for k, (at, level, title) in enumerate(found):
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                    start = len(t[:at].encode())
                    stop = len(t[: found[k + 1][0]].encode()) if k + 1 < len(found) else len(t.encode())
                    rows.append({"doc_id": key, "position": k, "level": level, "title": title, "ancestors": [x for _, x in stack], "byte_start": start, "byte_end": stop})
                    stack.append((level, title))
            yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))

    return docs.select(F.col(id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SECTIONS)


# Patterns of declarations per language; the first group is the name.
DECLARATIONS = {
    "typescript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)"), ("constant", r"^\s*(?:export\s+)?const\s+(\w+)\s*[:=]"), ("method", r"^\s+(?:(?:public|private|protected|static|readonly|async|get|set|override|abstract)\s+)*(?!(?:if|for|while|switch|catch|return|function|with|do|else)\b)([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^{;=]+)?\{\s*$"), ("import", r"^\s*import\s+.*?from\s+['\"]([^'\"]+)")],
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|readonly|async|get|set|override|abstract)\s+)*(?!(?:if|for|while|switch|catch|return|function|with|do|else)\b)([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^{;=]+)?\{\s*$"), ("import", r"^\s*import\s+.*?from\s+['\"]([^'\"]+)")],
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("import", r"^\s*(?:from\s+([\w.]+)\s+import|import\s+[\w.]+)")],
    "go": [("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("import", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$")],
    "rust": [("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"), ("import", r"^\s*use\s+([\w:]+)")],
    "java": [("class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\("), ("import", r"^\s*import\s+(?:static\s+)?([\w.]+)")],
    "ruby": [("module", r"^\s*module\s+(\w+)"), ("class", r"^\s*class\s+(\w+)"), ("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")],
}


def declared_symbols(files: DataFrame) -> DataFrame:
    """Symbols of (path, language, content) by declaration patterns: (path, kind, name, line). One generator per language
    and kind over the lines of that language's files; lines are made once."""
    lines = files.where(F.col("language").isin(list(DECLARATIONS))).select("path", "language", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    found = []
    for language, rules in DECLARATIONS.items():
        for kind, pattern in rules:
            hit = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
            found.append(F.when((F.col("language") == language) & hit.isNotNull(), F.struct(F.lit(kind).alias("kind"), hit.alias("name"))))
    each = F.explode(F.array_compact(F.array(*found))).alias("s")
    return lines.select("path", (F.col("line") + 1).alias("line"), each).select("path", "s.kind", "s.name", "line")


# Languages by the names that fences give them.
FENCES = {"py": "python", "python": "python", "ts": "typescript", "tsx": "typescript", "typescript": "typescript", "js": "javascript", "jsx": "javascript", "javascript": "javascript", "go": "go", "golang": "go", "rs": "rust", "rust": "rust", "java": "java", "rb": "ruby", "ruby": "ruby"}


def code_fences(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Fenced blocks of a known language as files: (path, language, content), the path being ``id/number``.

    A fence may be indented and may have more after its language; the end of the text closes the last one. Null and empty
    texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = re.compile(r"[ \t]*(`{3,}|~{3,})[ \t]*([\w+#-]*)(.*)$")
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fence, language, held, n = "", None, [], 0
                for line in [*(t or "").removeprefix("\ufeff").split("\n"), None]:
                    m = mark.match(line) if line is not None else None
                    if fence and (line is None or (m and m[1].startswith(fence) and not m[2] and not m[3].strip())):
                        if language:
                            rows.append({"path": f"{key}/{n}", "language": language, "content": "\n".join(held)})
                        fence, held, n = "", [], n + 1
                    elif fence:
                        held.append(line)
                    elif m:
                        fence, language = m[1], FENCES.get(m[2].lower())
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("language", pa.string()), ("content", pa.string())]))

    return docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "path string, language string, content string")


# How frameworks declare routes; groups are method and path.
ROUTES = [
    ("express", r"\b(?:app|router)\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)"),
    ("flask", r"@\w+\.(route|get|post|put|delete|patch)\(\s*['\"]([^'\"]+)"),
    ("spring", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?['\"]([^'\"]+)"),
    ("gin", r"\b\w+\.(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)"),
    ("rails", r"^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)"),
    ("actix", r"#\[(get|post|put|delete|patch)\(\"([^\"]+)"),
    ("laravel", r"Route::(get|post|put|delete|patch|any)\(\s*['\"]([^'\"]+)"),
]


def routes(files: DataFrame) -> DataFrame:
    """Routes of (path, content): (path, framework, method, route)."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("text"))
    found = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("framework"), F.lower(F.regexp_extract("text", p, 1)).alias("method"), F.regexp_extract("text", p, 2).alias("route"))) for k, p in ROUTES])
    return lines.select("path", F.explode(F.array_compact(found)).alias("r")).select("path", "r.framework", "r.method", "r.route")


def bridge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inferred edges between two sides that name the same thing: (source, target, kind, confidence)."""
    j = left.withColumnRenamed("id", "source").join(right.withColumnRenamed("id", "target"), list(keys))
    return j.where("source <> target").select("source", "target", F.lit("calls").alias("kind"), F.lit("inferred").alias("confidence")).distinct()


def match_rules(lines: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Findings of (doc_id, line_no, line) by rules (name, severity, pattern): (doc_id, line_no, rule, severity)."""
    hits = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rules])
    return lines.select("doc_id", "line_no", F.explode(F.array_compact(hits)).alias("f")).select("doc_id", "line_no", "f.rule", "f.severity")


# How manifests other than those of readers.dependencies declare packages; groups are name and constraint.
MANIFESTS = [
    ("rubygems", r"Gemfile$", r"^\s*gem\s+['\"]([\w-]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"),
    ("maven", r"build\.gradle(?:\.kts)?$", r"^\s*(?:implementation|api|compile|testImplementation|runtimeOnly)[\s(]+['\"]([\w.-]+:[\w.-]+):([\w.-]+)['\"]"),
    ("nuget", r"\.csproj$", r"<PackageReference\s+Include=\"([^\"]+)\"\s+Version=\"([^\"]+)\""),
    ("hex", r"mix\.exs$", r"\{\s*:(\w+)\s*,\s*\"([^\"]+)\""),
    ("pub", r"pubspec\.yaml$", r"^  ([a-z_0-9]+):\s*([\^~<>=]*\d[\w.+-]*)\s*$"),
    ("swift", r"Package\.swift$", r"\.package\(\s*url:\s*\"[^\"]*/([\w.-]+?)(?:\.git)?\"\s*,\s*(?:from:|exact:|\.upToNextMajor\(from:)\s*\"([^\"]+)\""),
]


def more_dependencies(files: DataFrame) -> DataFrame:
    """Declared packages of further manifests (path, content): (ecosystem, name, constraint, manifest)."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("text"))
    found = F.array(*[F.when(F.col("path").rlike(at) & F.col("text").rlike(p), F.struct(F.lit(e).alias("ecosystem"), F.regexp_extract("text", p, 1).alias("name"), F.regexp_extract("text", p, 2).alias("constraint"))) for e, at, p in MANIFESTS])
    by_line = lines.select("path", F.explode(F.array_compact(found)).alias("d")).select("d.ecosystem", "d.name", "d.constraint", F.col("path").alias("manifest"))
    pom = files.where(F.col("path").endswith("pom.xml")).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    part = lambda tag: F.trim(F.regexp_extract("d", rf"<{tag}>\s*([^<]+?)\s*</{tag}>", 1))
    maven = pom.select(F.lit("maven").alias("ecosystem"), F.concat(part("groupId"), F.lit(":"), part("artifactId")).alias("name"), part("version").alias("constraint"), F.col("path").alias("manifest"))
    php = files.where(F.col("path").endswith("composer.json")).select("path", F.from_json("content", "struct<require: map<string, string>>").alias("j")).select("path", F.explode("j.require").alias("name", "constraint"))
    composer = php.where(F.col("name").contains("/")).select(F.lit("composer").alias("ecosystem"), "name", "constraint", F.col("path").alias("manifest"))
    return by_line.unionByName(maven).unionByName(composer)


def cargo_lock(files: DataFrame) -> DataFrame:
    """(parent, child) pairs of lock files in sections of name and dependencies."""
    blocks = files.where(F.col("path").endswith("Cargo.lock")).select(F.explode(F.split("content", r"\[\[package\]\]")).alias("b"))
    deps = F.explode(F.regexp_extract_all(F.regexp_extract("b", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit(r"\"([\w-]+)"), F.lit(1)))
    return blocks.select(F.regexp_extract("b", r"name\s*=\s*\"([^\"]+)\"", 1).alias("parent"), deps.alias("child")).where("parent <> ''").distinct()


def transcripts(lines: DataFrame) -> DataFrame:
    """Counts of tools used per session in transcripts: one JSON object per line (value)."""
    schema = "struct<sessionId string, message struct<content array<struct<type string, name string>>>>"
    c = lines.select(F.from_json("value", schema).alias("r")).select("r.sessionId", F.explode("r.message.content").alias("c"))
    return c.where("c.type = 'tool_use'").groupBy("sessionId", F.col("c.name").alias("tool")).agg(F.count(F.lit(1)).alias("uses"))


# Operations of an interface description.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def openapi_sections(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Sections of interface descriptions in JSON: (doc_id, level, title, path, method, summary). The title is the first
    level, each path a second one and each operation of it a third. What is no such description has none."""
    operation = "struct<summary: string, operationId: string, description: string>"
    schema = f"struct<openapi: string, swagger: string, info: struct<title: string, description: string>, paths: map<string, struct<{', '.join(f'{m}: {operation}' for m in METHODS)}>>>"
    d = docs.where(F.col(text).isNotNull() & F.try_parse_json(text).isNotNull()).select(F.col(id).cast("string").alias("doc_id"), F.from_json(text, schema).alias("j"))
    d = d.where("j.openapi is not null or j.swagger is not null")
    none = F.lit(None).cast("string")
    top = d.select("doc_id", F.lit(1).alias("level"), F.coalesce("j.info.title", F.lit("API")).alias("title"), none.alias("path"), none.alias("method"), F.col("j.info.description").alias("summary"))
    p = d.select("doc_id", F.explode("j.paths").alias("path", "ops"))
    second = p.select("doc_id", F.lit(2).alias("level"), F.col("path").alias("title"), "path", none.alias("method"), none.alias("summary"))
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(f"ops.{m}").isNotNull(), F.struct(F.lit(m).alias("method"), F.col(f"ops.{m}").alias("o"))) for m in METHODS]))).alias("x")
    third = p.select("doc_id", "path", each).select(
        "doc_id", F.lit(3).alias("level"), F.concat(F.upper("x.method"), F.lit(" "), "path").alias("title"), "path", F.col("x.method").alias("method"), F.coalesce("x.o.summary", "x.o.operationId", "x.o.description").alias("summary")
    )
    return top.unionByName(second).unionByName(third)
