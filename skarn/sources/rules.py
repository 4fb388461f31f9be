"""Rules over source lines: a library of patterns, rules from files, and their findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.skew import salted_join

# Severities from the least to the worst.
SEVERITIES = ("info", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    languages: tuple[str, ...]  # none: all
    pattern: str
    fix: str = ""


_JS, _PY = ("javascript", "typescript"), ("python",)
LIBRARY = [
    Rule("dangerous-eval", "critical", "A03:injection", (*_JS, *_PY, "ruby"), r"(?<![\w.])eval\s*\(", "parse the value instead of running it"),
    Rule("dangerous-function", "high", "A03:injection", _JS, r"\bnew\s+Function\s*\("),
    Rule("dangerous-exec-js", "critical", "A03:injection", _JS, r"\b(?:execSync|exec)\s*\(\s*(?:`[^`]*\$\{|[^)]*\+)", "pass arguments as a list to execFile"),
    Rule("dangerous-exec-python", "critical", "A03:injection", _PY, r"\bsubprocess\.\w+\([^)]*shell\s*=\s*True|\bos\.(?:system|popen)\s*\(", "pass arguments as a list without a shell"),
    Rule("sql-injection-concat", "critical", "A03:injection", (), r"(?i)(?:query|execute|raw)\s*\(\s*(?:f?['\"`])\s*(?:select|insert|update|delete)\b[^'\"`]*(?:['\"`]\s*[+%]|\$\{|\{\w)", "use parameters of the statement"),
    Rule("inner-html", "high", "A03:injection", _JS, r"\.(?:inner|outer)HTML\s*=|dangerouslySetInnerHTML|document\.write\s*\("),
    Rule("weak-crypto-hash", "medium", "A02:cryptography", (), r"(?i)(?:createHash\(\s*['\"](?:md5|sha1)|hashlib\.(?:md5|sha1)\s*\(|MessageDigest\.getInstance\(\s*\"(?:MD5|SHA-?1)\"|\bmd5\.(?:New|Sum)\b|\bsha1\.(?:New|Sum)\b|Digest::(?:MD5|SHA1)\b)", "use SHA-256 or a password hash"),
    Rule("weak-crypto-cipher", "high", "A02:cryptography", (), r"(?i)createCipher\(|\b(?:DES|RC4|Blowfish)\.new\(|Cipher\.getInstance\(\s*\"(?:DES|RC4|AES/ECB)|\bdes\.NewCipher\b", "use AES-GCM with a fresh nonce"),
    Rule("insecure-random", "medium", "A02:cryptography", (), r"(?i)(?:token|secret|password|nonce|salt|session)\w*\s*[:=]+\s*[^;\n]*(?:Math\.random\(|\brandom\.(?:random|randint|choice)\()", "use the system's random source"),
    Rule("tls-unverified", "high", "A02:cryptography", (), r"(?i)rejectUnauthorized\s*:\s*false|verify\s*=\s*False|InsecureSkipVerify\s*:\s*true|CURLOPT_SSL_VERIFYPEER\s*,\s*(?:0|false)|danger_accept_invalid_certs\(true\)"),
    Rule("hardcoded-secret", "high", "A07:authentication", (), r"(?i)\b(?:password|passwd|secret|api_?key|auth_?token)\b\s*[:=]\s*['\"][^'\"\s$<{]{8,}['\"]", "read it from the environment"),
    Rule("jwt-none", "critical", "A07:authentication", (), r"(?i)algorithms?\s*[:=]\s*\[?\s*['\"]none['\"]"),
    Rule("path-traversal-join", "high", "A01:access", (*_JS, *_PY), r"(?:readFile(?:Sync)?|sendFile|open|createReadStream)\s*\([^)]*\breq(?:uest)?\.(?:params|query|body|args|form)\b", "resolve the path and check its folder"),
    Rule("open-redirect", "medium", "A01:access", (*_JS, *_PY), r"\bredirect\s*\(\s*req(?:uest)?\.(?:params|query|body|args)\b"),
    Rule("cors-any", "medium", "A05:configuration", (), r"(?i)access-control-allow-origin['\"]?\s*[,:]\s*['\"]\*|\borigin\s*:\s*['\"]\*['\"]"),
    Rule("debug-on", "low", "A05:configuration", _PY, r"\bDEBUG\s*=\s*True\b|\brun\([^)]*debug\s*=\s*True"),
    Rule("unsafe-yaml", "high", "A08:integrity", _PY, r"\byaml\.(?:load|unsafe_load)\s*\((?![^)]*SafeLoader)", "use safe_load"),
    Rule("unsafe-pickle", "high", "A08:integrity", _PY, r"\b(?:c?pickle|marshal|dill)\.loads?\s*\("),
    Rule("prototype-pollution", "high", "A08:integrity", _JS, r"\[['\"]__proto__['\"]\]|\.__proto__\s*(?:=(?!=)|\[)"),
    Rule("unsafe-block", "info", "A06:components", ("rust",), r"\bunsafe\s*\{"),
    Rule("swallowed-error", "low", "A09:logging", (), r"catch\s*(?:\([^)]*\))?\s*\{\s*\}|except(?:\s+\w+)?\s*:\s*pass\b"),
    Rule("request-forgery", "high", "A10:requests", (*_JS, *_PY), r"(?:\bfetch|axios\.\w+|requests\.\w+|urlopen)\s*\(\s*req(?:uest)?\.(?:params|query|body|args)\b"),
]


def load_rules(path: str) -> list[Rule]:
    """Rules of a YAML or JSON file: a list of maps (id, severity, category, languages, pattern, fix), or a map of one such
    list under ``rules``. The library for YAML is needed for YAML only."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("rules in YAML need the library yaml, which is not installed") from e
        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    found = []
    for r in data.get("rules", []) if isinstance(data, dict) else data or []:
        if r.get("severity", "medium") not in SEVERITIES:
            raise ValueError(f"unknown severity in rule {r.get('id')!r}")
        languages = r.get("languages") or ([r["language"]] if r.get("language") else [])
        found.append(Rule(r["id"], r.get("severity", "medium"), r.get("category", ""), tuple(languages), r["pattern"], r.get("fix", "")))
    return found


def table_of(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rule, severity, category, fix) of rules, which are parameters."""
    return spark.createDataFrame([(r.id, r.severity, r.category, r.fix) for r in rules], "rule string, severity string, category string, fix string")


def findings(files: DataFrame, rules: Sequence[Rule] = LIBRARY, least: str = "info", comments: bool = False) -> DataFrame:
    """(path, line, rule, severity, category, text) of (path, language, content) rows: lines that a rule of their language
    matches, of at least a severity. Lines that are comments are left out unless wanted. All rules are one expression over
    the lines, which are made once. Null contents and languages of no rule have none."""
    wanted = [r for r in rules if SEVERITIES.index(r.severity) >= SEVERITIES.index(least)]
    if not wanted:
        return files.sparkSession.createDataFrame([], "path string, line int, rule string, severity string, category string, text string")
    lines = files.where(F.col("content").isNotNull()).select("path", "language", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    lines = lines if comments else lines.where(~F.col("text").rlike(r"^\s*(?://|#|\*|/\*)"))
    hits = []
    for r in wanted:
        c = F.col("text").rlike(r.pattern)
        hits.append(F.when(F.col("language").isin(list(r.languages)) & c if r.languages else c, F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"))))
    each = F.explode(F.array_compact(F.array(*hits))).alias("h")
    return lines.select("path", (F.col("at") + 1).alias("line"), F.trim("text").alias("text"), each).select("path", "line", "h.rule", "h.severity", "h.category", "text")


def enclosing(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings with the innermost function, method or class around their line: adds ``symbol`` (null outside of all)."""
    from skarn.operators.ranges import innermost

    symbols = nodes.where(F.col("kind").isin("function", "method", "class")).select(F.col("id").alias("range_id"), F.col("file_path").alias("path"), "start_line", "end_line")
    keyed = found.withColumn("finding", F.concat_ws("\u0001", "path", F.col("line").cast("string"), "rule"))
    inner = innermost(keyed.select("finding", "path", "line").distinct(), symbols, "path", "line", "start_line", "end_line", "finding", "range_id")
    return salted_join(keyed, inner.withColumnRenamed("node_id", "symbol"), "finding").drop("finding")
