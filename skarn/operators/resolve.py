"""Names to records: candidates of several strategies, the best of which wins by priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Strategy to (priority, score).
STRATEGIES = {"qualified": (1, 0.95), "suffix": (2, 0.85), "exact": (3, 0.9), "lower": (4, 0.5)}
# What an import of a relative path may leave out.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", ".py", "/__init__.py")


def resolve_names(refs: DataFrame, nodes: DataFrame, name: str = "ref_name", threshold: float = 0.5) -> DataFrame:
    """Best node per distinct reference name: (ref_name, node_id, strategy, score).

    Each strategy is an equi-join on its own key; candidates of a name are reduced to one per strategy before the join,
    so a name that very many symbols share adds one row, not a group. Ties go to the smallest id.
    """
    wanted = refs.where(F.col(name).isNotNull()).select(F.col(name).alias("ref_name")).distinct()
    n = nodes.where("id is not null").select("id", "name", "qualified_name")
    last = F.element_at(F.split("ref_name", r"\.|::"), -1)
    keys = {"qualified": (F.col("ref_name"), F.col("qualified_name")), "suffix": (last, F.col("name")), "exact": (F.col("ref_name"), F.col("name")), "lower": (F.lower("ref_name"), F.lower("name"))}
    tiers = []
    for s, (left, right) in keys.items():
        rank, score = STRATEGIES[s]
        if score < threshold:
            continue
        side = n.select(right.alias("k"), "id").where("k is not null").groupBy("k").agg(F.min("id").alias("node_id"))
        own = wanted.where(F.col("ref_name").rlike(r"\.|::")) if s == "suffix" else wanted
        tiers.append(own.withColumn("k", left).join(side, "k").select("ref_name", "node_id", F.lit(s).alias("strategy"), F.lit(score).alias("score"), F.lit(rank).alias("rank")))
    u = tiers[0]
    for t in tiers[1:]:
        u = u.unionByName(t)
    return u.groupBy("ref_name").agg(F.min(F.struct("rank", "node_id", "strategy", "score")).alias("m")).select("ref_name", "m.node_id", "m.strategy", "m.score")


def resolve_types(names: DataFrame, nodes: DataFrame, name: str = "ref_name", kinds: Sequence[str] = ("class", "interface", "trait", "protocol", "struct")) -> DataFrame:
    """Node per type name; type-like kinds come first, then anything else."""
    side = nodes.where("name is not null").groupBy(F.col("name").alias("ref_name")).agg(F.min(F.struct((~F.col("kind").isin(list(kinds))).alias("other"), "id")).alias("m"))
    return names.select(F.col(name).alias("ref_name")).distinct().join(side, "ref_name").select("ref_name", F.col("m.id").alias("node_id"))


def resolve_imports(imports: DataFrame, files: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Relative imports (from_file, spec) to files (file_path): the first suffix that names a file."""
    from skarn.functions.text import normalise_path

    folder = F.regexp_replace("from_file", r"/[^/]*$", "")
    base = normalise_path(F.concat(folder, F.lit("/"), F.col("spec")))
    candidates = F.posexplode(F.transform(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.concat(F.col("base"), s))).alias("rank", "file_path")
    c = imports.where(F.col("spec").startswith(".")).select("from_file", "spec", base.alias("base")).distinct().select("from_file", "spec", candidates)
    return c.join(files.select("file_path").distinct(), "file_path", "left_semi").groupBy("from_file", "spec").agg(F.expr("min_by(file_path, rank)").alias("to_file"))


def namespace_prefixes(nodes: DataFrame) -> DataFrame:
    """Every dotted prefix of the qualified names of type-like symbols with its smallest node: (prefix, node_id)."""
    parts = F.split("qualified_name", r"\.")
    p = nodes.where(F.col("kind").isin("class", "interface", "trait", "module", "namespace") & F.col("qualified_name").isNotNull())
    listed = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ".")))
    return p.select(listed.alias("prefix"), "id").groupBy("prefix").agg(F.min("id").alias("node_id"))


def ambiguity(refs: DataFrame, nodes: DataFrame, name: str = "ref_name") -> DataFrame:
    """Confidence of a name alone: 1 over the number of nodes that have it."""
    n = nodes.where("name is not null").groupBy(F.col("name").alias("ref_name")).agg(F.count_distinct("id").alias("n"))
    return refs.select(F.col(name).alias("ref_name")).distinct().join(n, "ref_name").select("ref_name", F.round(1 / F.col("n"), 6).alias("confidence"))


def _least(ranked: DataFrame, *keys: str) -> DataFrame:
    return ranked.groupBy(*keys).agg(F.min(F.struct("rank", "node_id", "strategy")).alias("m")).select(*keys, "m.node_id", "m.strategy")


def resolve_specs(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """What imports (from_file, spec) name: (from_file, spec, node_id, strategy).

    A relative path is a file, answered by its smallest symbol. Any other: a wildcard is its namespace; then an exact
    qualified name, a name within a namespace that its qualified name begins with, a namespace of that very name, and last
    anything in a namespace of that prefix. Each way is an equi-join on keys with one row on the symbols' side, but for
    names within namespaces, whose candidates are joined by (name, prefix).
    """
    asked = imports.where("spec is not null").select("from_file", "spec").distinct()
    n = nodes.where("id is not null")
    first = lambda key: n.select(key.alias("k"), "id").where("k is not null").groupBy("k").agg(F.min("id").alias("node_id"))
    by_file = first(F.col("file_path")).withColumnRenamed("k", "to_file")
    relative = resolve_imports(asked, n.select("file_path")).join(by_file, "to_file").select("from_file", "spec", "node_id", F.lit("import-path").alias("strategy"), F.lit(1).alias("rank"))
    other = asked.where(~F.col("spec").startswith("."))
    prefixes = namespace_prefixes(n).withColumnRenamed("prefix", "k")
    wild = F.col("spec").endswith("*")
    ways = [
        (other.where(wild), F.regexp_replace("spec", r"\.?\*$", ""), prefixes, "wildcard", 2),
        (other.where(~wild), F.col("spec"), first(F.col("qualified_name")), "qualified", 3),
        (other.where(~wild), F.col("spec"), n.where("kind = 'namespace'").groupBy(F.col("name").alias("k")).agg(F.min("id").alias("node_id")), "namespace", 5),
        (other.where(~wild), F.col("spec"), prefixes, "prefix", 6),
    ]
    out = relative
    for side, key, known, strategy, rank in ways:
        out = out.unionByName(side.withColumn("k", key).join(known, "k").select("from_file", "spec", "node_id", F.lit(strategy).alias("strategy"), F.lit(rank).alias("rank")))
    # Every leading part of a symbol's qualified name up to a dot is a namespace that it lies in.
    parts = F.split("qualified_name", r"\.")
    within = n.where("name is not null and qualified_name is not null").select("id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("space"))
    within = within.groupBy("name", "space").agg(F.min("id").alias("node_id"))
    dotted = other.where(~wild & F.col("spec").contains(".")).select("from_file", "spec", F.element_at(F.split("spec", r"\."), -1).alias("name"), F.regexp_replace("spec", r"\.[^.]*$", "").alias("space"))
    out = out.unionByName(dotted.join(within, ["name", "space"]).select("from_file", "spec", "node_id", F.lit("name in namespace").alias("strategy"), F.lit(4).alias("rank")))
    return _least(out, "from_file", "spec")


def emit_edges(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of resolved references and the references that nothing answers.

    refs: (source, ref_name, ref_kind, file_path, line), kinds import, extends, implements, and anything else, which is a
    call. Edges: (source, target, kind, line, strategy). Failures: the references with the strategies that were tried.
    Each distinct name is resolved once, however many references have it.
    """
    kind = F.coalesce("ref_kind", F.lit("call"))
    r = refs.where("source is not null and ref_name is not null").withColumn("sort", F.when(kind == "import", "imports").when(kind.isin("extends", "implements"), kind).otherwise("calls"))
    imports, types, calls = r.where("sort = 'imports'"), r.where("sort in ('extends', 'implements')"), r.where("sort = 'calls'")
    spec = resolve_specs(imports.select(F.col("file_path").alias("from_file"), F.col("ref_name").alias("spec")), nodes).toDF("file_path", "ref_name", "target", "strategy")
    named = resolve_types(types, nodes).select("ref_name", F.col("node_id").alias("target"), F.lit("type-name").alias("strategy"), F.lit(1).alias("rank"))
    exact = nodes.where("id is not null and qualified_name is not null").groupBy(F.col("qualified_name").alias("ref_name")).agg(F.min("id").alias("target"))
    whole = types.select("ref_name").distinct().join(exact, "ref_name").select("ref_name", "target", F.lit("type-name").alias("strategy"), F.lit(2).alias("rank"))
    type_of = named.unionByName(whole).groupBy("ref_name").agg(F.min(F.struct("rank", "target", "strategy")).alias("m")).select("ref_name", "m.target", "m.strategy")
    call_of = resolve_names(calls, nodes).select("ref_name", F.col("node_id").alias("target"), "strategy")
    tried = {"imports": ["import-path"], "types": ["type-name"], "calls": ["qualified", "suffix", "exact", "lower"]}
    joined = None
    for side, known, keys, how in ((imports, spec, ["file_path", "ref_name"], "imports"), (types, type_of, ["ref_name"], "types"), (calls, call_of, ["ref_name"], "calls")):
        attempts = F.array(*[F.lit(t) for t in tried[how]])
        attempts = attempts if how != "calls" else F.filter(attempts, lambda t: (t != "suffix") | F.col("ref_name").rlike(r"\.|::"))
        part = side.join(known, keys, "left").select("source", "ref_name", "file_path", "line", "sort", "target", "strategy", attempts.alias("attempted"))
        joined = part if joined is None else joined.unionByName(part)
    edges = joined.where("target is not null").select("source", "target", F.col("sort").alias("kind"), "line", "strategy")
    return edges, joined.where("target is null").select("source", "ref_name", F.col("sort").alias("kind"), "file_path", "line", "attempted")
