"""Shorter texts for readers with little room: prose, logs and command output, with code, links and names kept."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Words that prose can do without, by strength.
FILLERS = ["actually", "basically", "really", "very", "quite", "just", "simply", "essentially", "obviously", "clearly", "certainly", "definitely", "probably", "perhaps", "maybe", "somewhat", "rather", "in order to", "please note that", "it should be noted that", "as a matter of fact"]
ARTICLES = ["the", "a", "an"]
SHORTER = {"in order to": "to", "due to the fact that": "because", "at this point in time": "now", "in the event that": "if", "with regard to": "about", "a large number of": "many", "is able to": "can", "for example": "e.g."}

_KEPT = re.compile(r"```.*?```|`[^`\n]*`|https?://\S+|(?:[\w.-]+/)+[\w.-]+|\bv?\d+\.\d+(?:\.\d+)*\b|\b[a-z]+[A-Z]\w*\b|\b\w+_\w+\b", re.S)


def shorten(text: str, level: str = "lite") -> str:
    """Prose with fillers removed (lite), articles too (full), and repeated blanks and words (ultra).

    Code, links, paths, versions and identifiers stay as they are.
    """
    if level not in ("lite", "full", "ultra"):
        raise ValueError("levels are lite, full, ultra")
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m.group())
        return f"\x00{len(kept) - 1}\x00"

    out = _KEPT.sub(keep, text)
    for a, b in SHORTER.items():
        out = re.sub(rf"\b{re.escape(a)}\b", b, out, flags=re.I)
    drop = FILLERS + (ARTICLES if level != "lite" else [])
    out = re.sub(r"\b(?:" + "|".join(sorted(map(re.escape, drop), key=len, reverse=True)) + r")\b[ ,]*", "", out, flags=re.I)
    if level == "ultra":
        out = re.sub(r"\b(\w+)(?:\s+\1\b)+", r"\1", out, flags=re.I)
        out = re.sub(r"[ \t]{2,}", " ", out)
    out = re.sub(r"[ \t]+([.,;:!?])", r"\1", out)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], out)


def shorten_column(c: Column, level: str = "lite") -> Column:
    @F.pandas_udf("string")
    def run(v):
        return v.map(lambda t: None if t is None else shorten(t, level))

    return run(c)


def cut_repeats(text: str, most: int = 3) -> str:
    """A text without what follows the ``most``-th equal sentence in a row."""
    out, run, before = [], 0, None
    for s in re.split(r"(?<=[.!?])\s+", text):
        run = run + 1 if s == before else 1
        before = s
        if run > most:
            break
        out.append(s)
    return " ".join(out)


# Command families by the words that a command begins with.
FAMILIES = [("git", r"^git\b"), ("github", r"^gh\b"), ("docker", r"^(docker|podman|kubectl)\b"), ("package", r"^(npm|yarn|pnpm|pip|cargo|go get|bundle|poetry|apt|brew)\b"), ("test", r"^(pytest|jest|vitest|go test|cargo test|mvn test|npm test|rspec)\b"), ("lint", r"^(eslint|ruff|pylint|flake8|mypy|tsc|clippy|golangci-lint|rubocop)\b"), ("aws", r"^aws\b"), ("files", r"^(ls|find|tree|cat|head|tail|grep|rg|du|df)\b")]


def family(command: Column) -> Column:
    """Family of a command, else generic."""
    c = F.when(F.lit(False), "generic")
    for name, pattern in sorted(FAMILIES, key=lambda f: f[0] != "test"):
        c = c.when(F.trim(command).rlike(pattern), name)
    return c.otherwise("generic")


def _git(lines: list[str]) -> list[str]:
    keep = re.compile(r"^(commit |diff --git|@@|[+-](?![+-])|\s*(modified|new file|deleted|renamed):|On branch|\?\?|[ MADRCU?]{2} |.*\|\s+\d+|\s*\d+ files? changed)")
    return [x for x in lines if keep.match(x)]


def _tests(lines: list[str]) -> list[str]:
    keep = re.compile(r"(?i)(fail|error|assert|panic|exception|traceback|^\s*at |^E  |\d+ (passed|failed|skipped))")
    return [x for x in lines if keep.search(x)]


def _lint(lines: list[str]) -> list[str]:
    keep = re.compile(r"(?i)(error|warning|\w+\.\w+:\d+|problems?)")
    return [x for x in lines if keep.search(x)]


def _package(lines: list[str]) -> list[str]:
    keep = re.compile(r"(?i)(added|removed|updated|installed|vulnerab|warn|err|success|conflict)")
    return [x for x in lines if keep.search(x)]


def _docker(lines: list[str]) -> list[str]:
    noise = re.compile(r"^\s*(?:[0-9a-f]{12}: |#\d+ (?:sha256:|extracting|\d+\.\d+ )|(?:Pulling|Waiting|Downloading|Extracting|Verifying Checksum|Download complete|Pull complete|Digest|Preparing|Pushed|Layer already exists)\b|--->|Removing intermediate container)")
    return [re.sub(r"\s{3,}", "  ", x).rstrip() for x in lines if not noise.match(x)]


def _aws(lines: list[str]) -> list[str]:
    """Without brackets of their own and metadata; what is left in one line per value."""
    noise = re.compile(r"^\s*[\[\]{}],?\s*$|\"(?:ResponseMetadata|RequestId|HTTPHeaders|HTTPStatusCode|RetryAttempts|ETag|NextToken|OwnerId|Arn)\"\s*:", re.I)
    return [x.strip().rstrip(",") for x in lines if not noise.search(x)]


def _files(lines: list[str]) -> list[str]:
    """Listings of paths as counts per folder where there are many; other output as it is."""
    paths = [x.strip() for x in lines if re.fullmatch(r"\s*\.?/?[\w.@+-]+(?:/[\w.@+-]+)+/?\s*", x)]
    if len(paths) < 20 or len(paths) < 0.8 * sum(bool(x.strip()) for x in lines):
        return lines
    folders: dict[str, int] = {}
    for p in paths:
        folder = p.rstrip("/").rpartition("/")[0]
        folders[folder] = folders.get(folder, 0) + 1
    return [f"{folder}/ ({n})" for folder, n in sorted(folders.items())]


def _github(lines: list[str]) -> list[str]:
    noise = re.compile(r"^\s*$|^(?:Showing \d+ of|View this|https://|--\s*$|\s*[─━-]{4,})")
    return [re.sub(r"\t+|\s{3,}", "  ", x).rstrip() for x in lines if not noise.match(x)]


FILTERS: dict[str, Callable[[list[str]], list[str]]] = {
    "git": _git, "test": _tests, "lint": _lint, "package": _package, "docker": _docker, "aws": _aws, "files": _files, "github": _github,
}


def generic(lines: list[str], limit: int = 100) -> list[str]:
    """Without blank lines and progress bars; runs that differ in numbers only become one; then head and tail."""
    out: list[str] = []
    before, run = None, 0
    for x in lines:
        if not x.strip() or re.search(r"[█▓░]{3,}|\d+%\s*\|", x):
            continue
        plain = re.sub(r"\d+", "#", x)
        run = run + 1 if plain == before else 0
        before = plain
        if run == 0:
            out.append(x)
        elif run == 1:
            out.append("  ... similar lines")
    return out if len(out) <= limit else [*out[: int(limit * 0.6)], f"... {len(out) - limit} lines ...", *out[-int(limit * 0.4) :]]


def output(command_family: str, text: str, limit: int = 100) -> str:
    """Shorter output of a command; when its family's filter leaves nothing, or it failed, the generic one is used."""
    lines = text.split("\n")
    kept = FILTERS.get(command_family, lambda x: x)(lines)
    return "\n".join(generic(kept or lines, limit))


def compress_log(records: DataFrame) -> DataFrame:
    """(command, family, original, compressed) tokens of (command, text) rows."""
    fam = family(F.col("command"))

    @F.pandas_udf("string")
    def run(f, t):
        return f.combine(t, lambda a, b: None if b is None else output(a, b))

    r = records.withColumn("family", fam).withColumn("short", run("family", "text"))
    return r.select("command", "family", F.ceil(F.length("text") / 4).alias("original"), F.ceil(F.length("short") / 4).alias("compressed"))
