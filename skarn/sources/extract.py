"""Source text to a graph: symbols, containment and references that are still to be resolved.

Declarations are told by their lines (the patterns of :data:`skarn.sources.formats.DECLARATIONS`), their extent by
indentation. A reference belongs to the innermost symbol around it. Each file is read on its own, so files are the unit of
work; references between files are resolved afterwards by joins (:func:`skarn.operators.resolve.emit_edges`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skarn.operators.resolve import emit_edges
from skarn.session import cut
from skarn.sources.formats import DECLARATIONS

# Words before a parenthesis that call nothing.
KEYWORDS = frozenset(
    "if for while switch catch return function def fn func class with elif else except assert print await yield lambda new typeof super match case when unless until and or not in is do try throw raise import from sizeof".split()
)
_CALL = re.compile(r"(?<![\w$.@#])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*\(")
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`|//[^\n]*|(?<![\w)])#[^\n]*")
_EXTENDS = re.compile(r"\bextends\s+([\w$.<>, ]+?)(?=\s+implements\b|\s*[{:(]|\s*$)")
_IMPLEMENTS = re.compile(r"\bimplements\s+([\w$.<>, ]+?)(?=\s*\{|\s*$)")
_PY_BASES = re.compile(r"^\s*class\s+\w+\s*\(([^)]*)\)")
_IMPL = re.compile(r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)")
_EXPORTED = {"typescript": re.compile(r"^\s*export\b"), "javascript": re.compile(r"^\s*export\b"), "rust": re.compile(r"^\s*pub\b"), "java": re.compile(r"^\s*public\b")}
_COMPILED = {language: [(kind, re.compile(p)) for kind, p in rules] for language, rules in DECLARATIONS.items()}
SCOPES = frozenset(("class", "interface", "struct", "trait", "module", "enum"))

GRAPH = (
    "part string, id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, is_exported boolean, parent string, ref_name string"
)
_FIELDS = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in GRAPH.split(", "))])


def names_in(listed: str) -> list[str]:
    """The bare names of a list of types."""
    return [n for n in (re.sub(r"<.*?>|\s.*", "", x.strip()) for x in listed.split(",")) if n and re.fullmatch(r"[\w$.]+", n)]


def parse(path: str, language: str, text: str | None) -> Iterator[dict]:
    """Rows of one file: its own symbol, its declarations and its references."""
    if language not in _COMPILED:
        return
    lines = (text or "").split("\n")
    yield {"part": "node", "id": path, "kind": "file", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "file_path": path, "language": language, "start_line": 1, "end_line": len(lines), "is_exported": False}
    indent = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    open_scopes: list[tuple[int, dict]] = []  # (indentation, symbol), outermost first
    found: list[dict] = []
    refs: list[dict] = []
    for i, line in enumerate(lines):
        if indent[i] < 0:
            continue
        # A symbol ends before the next line that isn't indented more, but for one that only closes it.
        while open_scopes and indent[i] <= open_scopes[-1][0]:
            at, s = open_scopes.pop()
            closes = indent[i] == at and re.match(r"\s*(?:[})\]]|end\b)", line)
            s["end_line"] = i + 1 if closes else max(s["start_line"], last)
        last = i + 1
        declared = None
        for kind, pattern in _COMPILED[language]:
            m = pattern.match(line)
            if not m or not m.group(1):
                continue
            name = m.group(1)
            holder = open_scopes[-1][1] if open_scopes else None
            owner = holder["id"] if holder else path
            if kind == "import":
                refs.append({"part": "ref", "parent": owner, "kind": "import", "ref_name": name, "file_path": path, "language": language, "start_line": i + 1})
                declared = declared or {}
                continue
            if kind == "function" and holder and holder["kind"] in SCOPES:
                kind = "method"
            q = f"{holder['qualified_name']}.{name}" if holder else f"{path}::{name}"
            declared = {
                "part": "node", "id": f"{q}#{i + 1}", "kind": kind, "name": name, "qualified_name": q, "file_path": path, "language": language, "start_line": i + 1, "end_line": i + 1,
                "signature": line.strip().rstrip("{:").strip(), "is_exported": bool(_EXPORTED[language].match(line)) if language in _EXPORTED else not name.startswith("_") if language == "python" else name[:1].isupper(), "parent": owner,
            }
            found.append(declared)
            bases = [("extends", n) for m in [_EXTENDS.search(line)] if m for n in names_in(m.group(1))] + [("implements", n) for m in [_IMPLEMENTS.search(line)] if m for n in names_in(m.group(1))]
            if language == "python" and kind == "class" and (m := _PY_BASES.match(line)):
                bases = [("extends", n) for n in names_in(m.group(1)) if "=" not in n]
            refs += [{"part": "ref", "parent": declared["id"], "kind": k, "ref_name": n, "file_path": path, "language": language, "start_line": i + 1} for k, n in bases]
            break
        if language == "rust" and (m := _IMPL.match(line)):
            refs.append({"part": "ref", "parent": open_scopes[-1][1]["id"] if open_scopes else path, "kind": "implements", "ref_name": m.group(1), "file_path": path, "language": language, "start_line": i + 1})
        if declared is None:
            owner = open_scopes[-1][1]["id"] if open_scopes else path
            for c in _CALL.finditer(_STRINGS.sub('""', line)):
                if c.group(1).split(".")[-1] not in KEYWORDS and c.group(1) not in KEYWORDS:
                    refs.append({"part": "ref", "parent": owner, "kind": "call", "ref_name": c.group(1).replace("->", ".").replace("::", "."), "file_path": path, "language": language, "start_line": i + 1})
        if declared:
            open_scopes.append((indent[i], declared))
    for _, s in open_scopes:
        s["end_line"] = max(s["start_line"], last)
    yield from found
    yield from refs


def source_graph(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, containment edges and references of (path, language, content) rows, which are parsed once.

    Null and empty contents have a file of no symbols; files of other languages are left out; a path that comes twice is
    parsed twice, and what both hold counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, language, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows = list(parse(path, language, text)) if path is not None and language is not None else []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    every = cut(files.select("path", "language", "content").mapInArrow(run, GRAPH).distinct(), "source")
    node = every.where("part = 'node'")
    nodes = node.select("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "signature", "is_exported")
    contains = node.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.col("start_line").alias("line"))
    refs = every.where("part = 'ref'").select(F.col("parent").alias("source"), "ref_name", F.col("kind").alias("ref_kind"), "file_path", F.col("start_line").alias("line"))
    return nodes, contains, refs


def resolved_graph(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, all edges (source, target, kind, line) and the references that nothing answers."""
    nodes, contains, refs = source_graph(files)
    edges, failed = emit_edges(refs, nodes)
    return nodes, contains.unionByName(edges.select("source", "target", "kind", "line")), failed
