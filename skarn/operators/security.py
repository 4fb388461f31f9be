"""Dependencies and findings: versions, matches by pattern and by distance, worst verdicts, baselines, orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skarn.functions.text import version_key

# Order of verdicts, the worst last.
VERDICTS = {"not_affected": 1, "under_investigation": 2, "affected": 3}


def worst_verdict(findings: DataFrame, keys: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """One row per key with its worst verdict and the number of findings; an aggregate, so no key is a hot sort."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv]), F.col(verdict)), F.lit(0))
    return findings.groupBy(*keys).agg(F.max(F.struct(rank.alias("rank"), F.col(verdict).alias("verdict"))).alias("m"), F.count(F.lit(1)).alias("findings")).select(*keys, "m.verdict", "findings")


def newest(dependencies: DataFrame) -> DataFrame:
    """One row per (ecosystem, name): the greatest version, all manifests in order."""
    best = F.max(F.struct(version_key(F.col("version")).alias("k"), "version"))
    return dependencies.groupBy("ecosystem", "name").agg(best.alias("m"), F.array_sort(F.collect_set("manifest")).alias("manifests")).select("ecosystem", "name", "m.version", "manifests")


def lookalikes(names: DataFrame, known: Sequence[str], most: int = 2) -> DataFrame:
    """Names at a small edit distance from a few well-known ones: (name, like, distance). The list is a parameter and is
    unrolled per row; the bound lets the distance give up early."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("like"), F.levenshtein(F.col("name"), F.lit(k), most).alias("distance")) for k in known])).alias("p")
    return names.select("name").distinct().select("name", pairs).select("name", "p.like", "p.distance").where((F.col("distance") >= 1) & (F.col("distance") <= most))


def by_wildcards(rows: DataFrame, column: str, rules: Sequence[tuple[str, str]], default: str) -> DataFrame:
    """Adds ``ruling``: the action of the first rule (wildcard, action) that matches, in any case."""
    from skarn.functions.text import wildcard_regex

    c = F.when(F.lit(False), F.lit(default))
    for pattern, action in rules:
        c = c.when(F.col(column).rlike(wildcard_regex(pattern)), action)
    return rows.withColumn("ruling", c.otherwise(default))


def baseline_diff(before: DataFrame, now: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """NEW, RESOLVED, CHANGED or UNCHANGED per key, in one aggregate over both sides."""
    both = before.select(*keys, F.col(value).alias("b"), F.lit(None).cast(now.schema[value].dataType).alias("n"), F.lit(1).alias("in_b"), F.lit(0).alias("in_n")).unionByName(
        now.select(*keys, F.lit(None).cast(before.schema[value].dataType).alias("b"), F.col(value).alias("n"), F.lit(0).alias("in_b"), F.lit(1).alias("in_n"))
    )
    g = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("b", "n", "in_b", "in_n")])
    state = F.when(F.col("in_b") == 0, "NEW").when(F.col("in_n") == 0, "RESOLVED").when(~F.col("b").eqNullSafe(F.col("n")), "CHANGED").otherwise("UNCHANGED")
    return g.select(*keys, state.alias("state"))


def layers(files: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Layer per file: of the rules (layer, glob, confidence) that match the most certain, the first among equals."""
    from skarn.functions.text import glob_regex

    found = F.array_compact(F.array(*[F.when(F.col("file_path").rlike(glob_regex(g)), F.struct(F.lit(-c).alias("c"), F.lit(i).alias("i"), F.lit(name).alias("layer"))) for i, (name, g, c) in enumerate(rules)]))
    best = F.array_min(found)
    return files.select("file_path", best["layer"].alias("layer"), (-best["c"]).alias("confidence")).where("layer is not null")


def import_dependencies(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Imports (spec) to declared packages by their longest leading path: (spec, name)."""
    from skarn.functions.text import path_prefixes

    listed = imports.select("spec").distinct().select("spec", F.explode(path_prefixes(F.col("spec"))).alias("name"))
    return listed.join(dependencies.select("name").distinct(), "name").groupBy("spec").agg(F.expr("max_by(name, length(name))").alias("name"))


def secrets(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Texts that hold something like a credential: (doc, rule, hits)."""
    rules = {"private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "cloud key": r"\bAKIA[0-9A-Z]{16}\b", "token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "assignment": r"(?i)\b(?:password|passwd|secret|api_?key|token)\s*[:=]\s*['\"][^'\"\s]{8,}['\"]", "address with password": r"\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@"}
    c = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count(F.col(text), F.lit(v)).alias("hits")) for k, v in rules.items()])).alias("r")
    return docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), c).select("doc", "r.rule", "r.hits").where("hits > 0")


def suppressed(findings: DataFrame, suppressions: DataFrame, keys: Sequence[str], today: str) -> DataFrame:
    """Findings without those that a suppression of their key covers that has no end or ends on a later day."""
    live = suppressions.where(F.col("expires").isNull() | (F.col("expires") > today)).select(*keys).distinct()
    return findings.join(live, list(keys), "left_anti")


def findings_with_context(vulnerabilities: DataFrame, edges: DataFrame, dependencies: DataFrame, reach: DataFrame) -> DataFrame:
    """Vulnerabilities with the packages they belong to and how those are reached: a chain of left joins on ids."""
    e = edges.where("kind = 'has_vulnerability'").select(F.col("source").alias("dep_id"), F.col("target").alias("vuln_id"))
    return vulnerabilities.join(e, "vuln_id", "left").join(dependencies, "dep_id", "left").join(reach, "dep_id", "left")


def orphan_dependencies(dependencies: DataFrame, edges: DataFrame, manifests: DataFrame) -> DataFrame:
    """Dependencies (id) without a declaring edge, or all of whose manifests are gone."""
    declared = edges.where("kind = 'declared_in'").select(F.col("source").alias("id"), F.col("target").alias("manifest"))
    alive = declared.join(manifests.select("manifest").distinct(), "manifest", "left_semi").select("id").distinct()
    return dependencies.select("id").distinct().join(alive, "id", "left_anti")


# Bounds of severity bands.
BANDS = {"critical": (9.0, 10.0), "high": (7.0, 8.9), "medium": (4.0, 6.9), "low": (0.1, 3.9)}
ORDERS = {"risk": "risk_score", "cvss": "severity_score", "epss": "epss_score", "name": "package_name"}


def vulnerability_list(findings: DataFrame, severity: str | None = None, verdict: str | None = None, epss: float | None = None, sort: str = "risk", n: int | None = None) -> DataFrame:
    """Findings of a severity band, verdict and least exploit score, in an order that puts nulls last."""
    if severity is not None:
        low, high = BANDS[severity.lower()]
        findings = findings.where(F.col("severity_score").between(low, high))
    if verdict is not None:
        if verdict not in VERDICTS:
            raise ValueError(f"unknown verdict {verdict!r}")
        findings = findings.where(F.col("verdict") == verdict)
    if epss is not None:
        findings = findings.where(F.col("epss_score") >= epss)
    by = F.col(ORDERS[sort])
    out = findings.orderBy(by.asc_nulls_last() if sort == "name" else by.desc_nulls_last(), "vuln_id", "dep_id")
    return out.limit(n) if n else out


def ci_report(findings: DataFrame, fail_on: str = "high") -> DataFrame:
    """One JSON text per finding and, in a row of its own, the totals and whether a build fails: (part, line)."""
    score = F.coalesce("severity_score", F.lit(0.0))
    band = F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score > 0, "low").otherwise("unknown")
    f = findings.withColumn("severity", band)
    line = F.to_json(F.struct("vuln_id", "package_name", "severity", "verdict"))
    total = f.agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == b).alias(b) for b in BANDS], F.count_if(F.col("severity_score") >= BANDS[fail_on][0]).alias("failing"))
    closing = total.select(F.lit(2).alias("part"), F.to_json(F.struct("findings", *BANDS, (F.col("failing") > 0).alias("fails"))).alias("line"))
    return f.select(F.lit(1).alias("part"), line.alias("line")).unionByName(closing)


# What a call leads to and comes from in each rule (patterns over the names of callee, caller and file).
FLOW_RULES = [
    ("dangerous-eval", "critical", "^(?:eval|Function|execSync|exec|spawn|spawnSync|execFileSync|execFile)$", None, None),
    ("unsafe-deserialize", "high", "^(?:unserialize|deserialize|fromJson|loads|yaml\\.load)$|(?i)pickle|(?i)marshal", None, None),
    ("hardcoded-crypto", "medium", "(?i)md5|sha1|des|rc4|blowfish", "(?i)crypto|hash|cipher|encrypt|digest", "(?i)crypto|hash|cipher|auth"),
    ("sql-injection", "critical", "^(?:query|execute|exec|raw|runQuery|executeQuery|runSql|executeSql)$", "(?i)handle|controller|route|request|req|endpoint|action|handler", None),
    ("path-traversal", "high", "^(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|openSync|unlink|unlinkSync)$", "(?i)controller|route|request|download|upload|get.*file|fetch.*file|serve.*file|handle.*file", None),
]
SANITIZERS = "(?i)sanitize|escape|parameteriz|prepared|placeholder"


def data_flows(nodes: DataFrame, edges: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Risky calls: (rule, severity, file_path, line, symbol, callee).

    A rule names the callee and, for some, the caller or its file. Callers of a sanitizer are no source of injections.
    matches (rule, severity, file_path, line, symbol), found in the source itself, replace calls in the same line.
    """
    from skarn.operators.review import ends

    calls = ends(edges.where("kind = 'calls'").select("source", "target").distinct(), nodes, "name", "file_path", "start_line")
    calls = calls.where("source_file_path <> ''").select("source", F.col("source_name").alias("symbol"), F.col("source_file_path").alias("file_path"), F.col("source_start_line").alias("line"), F.col("target_name").alias("callee"))
    hits = []
    for rule, severity, callee, caller, path in FLOW_RULES:
        c = F.col("callee").rlike(callee)
        if caller:
            c = c & (F.col("symbol").rlike(caller) | F.col("file_path").rlike(path) if path else F.col("symbol").rlike(caller))
        hits.append(F.when(c, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))))
    found = calls.select("*", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("source", "h.rule", "h.severity", "file_path", "line", "symbol", "callee")
    safe = calls.where(F.col("callee").rlike(SANITIZERS)).select("source", F.lit("sql-injection").alias("rule"))
    found = found.join(safe.distinct(), ["source", "rule"], "left_anti").drop("source").distinct()
    if matches is None:
        return found
    seen = matches.select("rule", "severity", "file_path", "line", "symbol", F.lit(None).cast("string").alias("callee"))
    return seen.unionByName(found.join(matches.select("file_path", "line").distinct(), ["file_path", "line"], "left_anti").select(seen.columns))


def security_hotspots(matches: DataFrame, edges: DataFrame, n: int | None = None) -> DataFrame:
    """Symbols (id) with findings (id, severity) by worst severity times callers: (id, worst, matches, callers, score)."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"critical": 4, "high": 3, "medium": 2, "low": 1}.items() for x in kv]), F.col("severity")), F.lit(0))
    m = matches.where("id is not null").groupBy("id").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("matches"))
    callers = edges.where("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    out = m.join(callers, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    out = out.withColumn("score", F.greatest(F.col("worst"), F.lit(1)) * F.greatest(F.col("callers"), F.lit(1)))
    return out.orderBy(F.desc("score"), "id").limit(n) if n else out


def impact_summary(paths: DataFrame, layers: DataFrame, most: int = 100) -> DataFrame:
    """Per vulnerability of paths (vuln_id, entry_point, path: array of file paths): its layers, entry points and number of
    distinct paths, which is told up to ``most``. Files of no layer are unclassified."""
    p = paths.select("vuln_id", "entry_point", "path").distinct()
    files = p.select("vuln_id", F.explode("path").alias("file_path")).distinct().join(layers.select("file_path", "layer"), "file_path", "left")
    by_layer = files.groupBy("vuln_id").agg(F.array_sort(F.collect_set(F.coalesce("layer", F.lit("unclassified")))).alias("layers"))
    n = p.groupBy("vuln_id").agg(F.count_distinct("entry_point").alias("entry_points"), F.least(F.count_distinct("path"), F.lit(most)).alias("paths"))
    return by_layer.join(n, "vuln_id")


def dependency_closure(direct: DataFrame, pairs: DataFrame, depth: int = 10) -> DataFrame:
    """Packages reached from declared ones (ecosystem, name) over (ecosystem, parent, child) pairs, within their ecosystem:
    (ecosystem, name, depth), in up to ``depth`` steps."""
    from skarn.operators.graph import bfs

    key = lambda e, n: F.concat_ws("\u0001", e, n)
    edges = pairs.select(key("ecosystem", "parent").alias("source"), key("ecosystem", "child").alias("target"), F.lit("depends_on").alias("kind"))
    reach = bfs(edges, direct.select(key("ecosystem", "name").alias("id")), depth)
    part = F.split("id", "\u0001")
    return reach.select(part[0].alias("ecosystem"), part[1].alias("name"), "depth")


def context_warnings(context: DataFrame, affected: DataFrame) -> DataFrame:
    """Vulnerabilities whose affected symbols (vuln_id, id) are among those of a context (id): (vuln_id, symbols)."""
    return affected.join(context.select("id").distinct(), "id", "left_semi").groupBy("vuln_id").agg(F.count_distinct("id").alias("symbols"))


def category_coverage(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Per category (the part of a rule's category before a colon) its rules and findings: (category, rules, findings)."""
    cat = lambda c: F.element_at(F.split(c, ":"), 1)
    r = rules.groupBy(cat(F.col("category")).alias("category")).agg(F.count_distinct("rule").alias("rules"))
    f = findings.join(rules.select("rule", cat(F.col("category")).alias("category")).distinct(), "rule").groupBy("category").agg(F.count(F.lit(1)).alias("findings"))
    return r.join(f, "category", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
