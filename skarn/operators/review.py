"""Reports over nodes and edges: refactoring, interfaces, coverage, layers, branches, sessions and structure of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skarn.operators.graph import bfs, file_imports
from skarn.session import cut
from skarn.skew import salted_join


def ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both ends as source_x and target_x; symbols with very many edges are spread."""
    out = edges
    for side in ("source", "target"):
        out = salted_join(out, nodes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side, "inner")
    return out


def folder(path: Column) -> Column:
    """The folder of a path; empty where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def affected_tests(nodes: DataFrame, edges: DataFrame, changed: DataFrame, tests: str, depth: int = 5, data_refs: DataFrame | None = None) -> DataFrame:
    """Test files (a pattern of paths) that import the changed files (id) in up to ``depth`` steps: (id). data_refs
    (file_path, code_file) adds the code that uses changed data files as a first step."""
    pairs = file_imports(nodes, edges).select(F.col("from_file").alias("source"), F.col("to_file").alias("target"), F.lit("imports").alias("kind"))
    if data_refs is not None:
        pairs = pairs.unionByName(data_refs.select(F.col("code_file").alias("source"), F.col("file_path").alias("target"), F.lit("uses").alias("kind")))
    return bfs(cut(pairs, "files"), changed, depth, None, "in", include_start=False).where(F.col("id").rlike(tests)).select("id")


def rename_preview(nodes: DataFrame, edges: DataFrame, symbol: DataFrame) -> DataFrame:
    """What a renaming of the symbols (id) touches: (id, direction, kind, file_path, start_line, other). Everything that
    leads to them, and their own imports and exports."""
    into = edges.join(symbol.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("id"), F.lit("in").alias("direction"), "kind", F.col("source").alias("other"))
    out = edges.where(F.col("kind").isin("imports", "exports")).join(symbol.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"), F.lit("out").alias("direction"), "kind", F.col("target").alias("other"))
    return into.unionByName(out).distinct().join(nodes.select(F.col("id").alias("other"), "file_path", "start_line"), "other").select("id", "direction", "kind", "file_path", "start_line", "other")


def node_context(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """What surrounds symbols (id): (id, role, other, kind, file_path), roles caller, callee, parent and child. The edges are
    read once for all roles; each pair of a role counts once."""
    e = edges.where(F.col("kind").isin("calls", "contains"))
    calls = F.col("kind") == "calls"
    side = lambda own, other, one, two: F.struct(F.col(own).alias("id"), F.when(calls, one).otherwise(two).alias("role"), F.col(other).alias("other"))
    both = e.select(F.explode(F.array(side("target", "source", "caller", "parent"), side("source", "target", "callee", "child"))).alias("r")).select("r.*")
    own = both.join(ids.select("id").distinct(), "id", "left_semi").distinct()
    return own.join(nodes.select(F.col("id").alias("other"), "kind", "file_path"), "other").select("id", "role", "other", "kind", "file_path")


def named_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """The symbol (id) of that name, else the one whose qualified name ends with it; of several the smallest id."""
    tier = F.when(F.col("name") == name, 1).when(F.col("qualified_name").endswith(name), 2)
    best = nodes.select("id", tier.alias("tier")).where("tier is not null").agg(F.min(F.struct("tier", "id")).alias("m"))
    return best.select("m.id").where("id is not null")


def suggestions(nodes: DataFrame, edges: DataFrame, calls: int = 5, symbols: int = 15, dead: int = 3) -> DataFrame:
    """Refactorings: (sort, subject, other, n, priority). move: files with many calls into a file of another folder;
    split: files of many symbols; extract: files with several exported symbols that nothing calls."""
    is_call = edges.where("kind = 'calls'")
    pairs = ends(is_call.select("source", "target"), nodes, "file_path").groupBy("source_file_path", "target_file_path").agg(F.count(F.lit(1)).alias("n"))
    far = pairs.where((F.col("n") >= calls) & (folder(F.col("source_file_path")) != folder(F.col("target_file_path"))))
    move = far.select(F.lit("move").alias("sort"), F.col("source_file_path").alias("subject"), F.col("target_file_path").alias("other"), "n", F.when(F.col("n") >= 2 * calls, "high").otherwise("medium").alias("priority"))
    coded = nodes.where(F.col("kind").isin("function", "method", "class"))
    none = F.lit(None).cast("string").alias("other")
    large = coded.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= symbols)
    split = large.select(F.lit("split").alias("sort"), F.col("file_path").alias("subject"), none, "n", F.when(F.col("n") >= 2 * symbols, "high").otherwise("medium").alias("priority"))
    unused = coded.where("is_exported").join(is_call.select(F.col("target").alias("id")), "id", "left_anti").groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= dead)
    extract = unused.select(F.lit("extract").alias("sort"), F.col("file_path").alias("subject"), none, "n", F.when(F.col("n") >= 8, "high").otherwise("low").alias("priority"))
    return move.unionByName(split).unionByName(extract)


def god_classes(edges: DataFrame, least: int = 10) -> DataFrame:
    return edges.where("kind = 'contains'").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("members"), (F.count(F.lit(1)) >= least).alias("god"))


def largest(nodes: DataFrame, n: int) -> DataFrame:
    loc = (F.col("end_line") - F.col("start_line") + 1).alias("loc")
    return nodes.where("end_line > start_line").select("id", loc).orderBy(F.desc("loc"), "id").limit(n)


def ranked(edges: DataFrame, kinds: list[str], n: int) -> DataFrame:
    """Symbols by the number of edges of some kinds that lead to them."""
    return edges.where(F.col("kind").isin(kinds)).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in")).orderBy(F.desc("fan_in"), "id").limit(n)


def without_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge but containment leaves: for imports, the unused ones."""
    return nodes.join(edges.where("kind <> 'contains'").select(F.col("source").alias("id")), "id", "left_anti")


def complexity(nodes: DataFrame, n: int, most: int = 15) -> DataFrame:
    return nodes.select("id", "cc", (F.col("cc") > most).alias("flagged")).orderBy(F.desc("cc"), "id").limit(n)


def to_simplify(nodes: DataFrame) -> DataFrame:
    return nodes.where("cc >= 10 or mi <= 50 or end_line - start_line + 1 >= 50").select("id", "cc")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of simple symbols, number of isolated ones and mean number of callers, as one row of scalar subqueries."""
    share = nodes.agg(F.round(F.avg(F.when(F.col("cc") <= 10, 1.0).otherwise(0.0)), 4).alias("simple_share"))
    alone = nodes.join(edges.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    fan = edges.where("kind = 'calls'").groupBy("target").agg(F.count(F.lit(1)).alias("k")).agg(F.round(F.avg("k"), 4).alias("mean_fan_in"))
    return share.withColumn("isolated", alone.scalar()).withColumn("mean_fan_in", fan.scalar())


def test_risk(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Complexity times callers of symbols above a bound."""
    k = edges.where("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return nodes.join(k, "id").select("id", (F.col("cc") * F.col("k")).alias("risk")).where(F.col("risk") > least)


def uncovered(nodes: DataFrame, edges: DataFrame, tests: str) -> DataFrame:
    """Exported functions and methods that no edge reaches from a test file (a pattern of paths)."""
    own = nodes.where(F.col("file_path").rlike(tests)).select(F.col("id").alias("source"))
    covered = edges.join(own, "source", "left_semi").select(F.col("target").alias("id"))
    return nodes.where("is_exported and kind in ('function', 'method')").join(covered, "id", "left_anti").select("id")


def package_files(nodes: DataFrame, edges: DataFrame, parts: int = 2) -> DataFrame:
    """Files of packages (the first parts of a path) that import or call files of others or their own: (src, dst, f, t)."""
    pkg = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, parts), "/")
    j = ends(edges.where("kind in ('imports', 'calls')").select("source", "target"), nodes, "file_path")
    j = j.select(pkg("source_file_path").alias("src"), pkg("target_file_path").alias("dst"), F.col("source_file_path").alias("f"), F.col("target_file_path").alias("t"))
    return j.where("f <> t").distinct()


def layer_dependencies(packages: DataFrame, layers: DataFrame) -> DataFrame:
    """Dependencies between layers: (source_layer, target_layer, deps). The layer of a package is that of its first file;
    packages (src, dst, f, t), layers (file_path, layer). Packages without a layer and layers with themselves are left out."""
    own = packages.select(F.col("src").alias("package"), F.col("f").alias("file_path")).unionByName(packages.select(F.col("dst").alias("package"), F.col("t").alias("file_path")))
    first = own.groupBy("package").agg(F.min("file_path").alias("file_path")).join(layers.select("file_path", "layer"), "file_path").select("package", "layer")
    counted = packages.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    j = counted.join(first.toDF("src", "source_layer"), "src").join(first.toDF("dst", "target_layer"), "dst").where("source_layer <> target_layer")
    return j.groupBy("source_layer", "target_layer").agg(F.sum("n").alias("deps"))


def coverage(files: DataFrame) -> DataFrame:
    """Covered share per file and, with a null file, overall, of (file, covered, total) rows: (file, covered, total, percent)."""
    g = files.groupBy("file").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    every = g.agg(F.lit(None).cast("string").alias("file"), F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    return g.unionByName(every).withColumn("percent", F.round(F.coalesce(F.try_divide(F.col("covered") * 100, F.col("total")), F.lit(0.0)), 1))


def branch_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symbols (id, qualified_name) of branch a against b: (id, change, now, before), in one aggregate over both."""
    side = lambda df, here: df.select("id", F.struct(F.lit(True).alias("on"), F.col("qualified_name").alias("q")).alias(here), F.lit(None).cast("struct<on: boolean, q: string>").alias("b" if here == "a" else "a"))
    both = side(a, "a").unionByName(side(b, "b")).groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a.q").eqNullSafe(F.col("b.q")), "changed")
    return both.select("id", change.alias("change"), F.col("a.q").alias("now"), F.col("b.q").alias("before")).where("change is not null")


def branch_search(nodes: DataFrame, term: str) -> DataFrame:
    """Symbols of a branch whose name or qualified name holds the term in any case: (name, kind, file_path, start_line)."""
    like = lambda c: F.col(c).ilike(f"%{term}%")
    return nodes.where(like("name") | like("qualified_name")).select("name", "kind", "file_path", "start_line").distinct()


def changelog(commits: DataFrame, touched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Commits (hash, author, date, subject) with the number of symbols whose lines their hunks overlap: touched has
    (hash, file_path, first_line, last_line). Commits without hunks have zero."""
    from skarn.operators.ranges import overlapping

    n = nodes.select("id", "file_path", "start_line", "end_line")
    hit = overlapping(n, touched, "file_path", "start_line", "end_line", "first_line", "last_line").select("hash", "id").distinct()
    k = hit.groupBy("hash").agg(F.count(F.lit(1)).alias("symbols"))
    return commits.select(F.substring("hash", 1, 7).alias("short_hash"), "hash", "date", "subject", "author").join(k, "hash", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0))).drop("hash")


def session_delta(before: dict[str, DataFrame], now: dict[str, DataFrame]) -> DataFrame:
    """Counts of symbols and edges at the start and the end of a session: (what, before, now, delta)."""
    out = None
    for what in before:
        n = before[what].agg(F.count(F.lit(1)).alias("before")).withColumn("now", now[what].agg(F.count(F.lit(1)).alias("n")).scalar())
        part = n.select(F.lit(what).alias("what"), "before", "now", (F.col("now") - F.col("before")).alias("delta"))
        out = part if out is None else out.unionByName(part)
    return out


# -- structure of files ---------------------------------------------------------------------------------------------
def structure(nodes: DataFrame) -> DataFrame:
    """Symbols of each file by line: (file_path, start_line, id, entry), the entry as a map of the file shows it."""
    mark = F.when(F.col("is_exported"), " [exported]").otherwise("")
    entry = F.format_string("L%d-%d  %s %s%s", "start_line", "end_line", "kind", "name", mark)
    return nodes.where("file_path is not null and start_line is not null").select("file_path", "start_line", "id", entry.alias("entry"))


def signatures(nodes: DataFrame) -> DataFrame:
    """Each symbol's signature, or kind, name and line where it has none: (file_path, start_line, id, entry)."""
    bare = F.format_string("%s %s (L%d)", "kind", "name", "start_line")
    own = F.when(F.trim(F.coalesce("signature", F.lit(""))) != "", F.col("signature")).otherwise(bare)
    return nodes.where("file_path is not null and start_line is not null").select("file_path", "start_line", "id", own.alias("entry"))


def imports_and_exports(nodes: DataFrame, exports: bool) -> DataFrame:
    """Imported names, or exported symbols with their kind, of each file: (file_path, start_line, id, entry)."""
    picked = nodes.where("is_exported" if exports else "kind = 'import'").where("file_path is not null and start_line is not null")
    entry = F.format_string("%s %s (L%d)", "kind", "name", "start_line") if exports else F.format_string("%s (L%d)", "name", "start_line")
    return picked.select("file_path", "start_line", "id", entry.alias("entry"))


def numbered_lines(text: Column, first: Column | int, last: Column | int) -> Column:
    """Lines from ``first`` to ``last`` with their numbers, within the text's bounds."""
    lines = F.split(text, "\n")
    a = F.greatest(F.lit(1), F.lit(first) if isinstance(first, int) else first)
    z = F.least(F.size(lines), F.lit(last) if isinstance(last, int) else last)
    picked = F.slice(lines, a, F.greatest(z - a + 1, F.lit(0)))
    return F.array_join(F.transform(picked, lambda l, i: F.concat((i + a).cast("string"), F.lit(": "), l)), "\n")


#: Lines of the newer text in which a line of the older one is looked for.
AHEAD = 4


def line_diff(old: str | None, new: str | None) -> str:
    """Lines that went (-) and came (+) between two texts, by a walk that looks a few lines ahead for the old line."""
    if old is None or old == new:
        return ""
    a, b = old.split("\n"), (new or "").split("\n")
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        near = b[j + 1 : j + 1 + AHEAD]
        if a[i] in near:
            stop = j + 1 + near.index(a[i])
            out += [f"+ {x}" for x in b[j:stop]]
            j = stop
        else:
            out += [f"- {a[i]}", f"+ {b[j]}"]
            i, j = i + 1, j + 1
    return "\n".join(out + [f"- {x}" for x in a[i:]] + [f"+ {x}" for x in b[j:]])


def diff_column(old: Column, new: Column) -> Column:
    """The same over columns, in Arrow batches: each text is walked once, and equal texts cost a comparison."""

    @F.pandas_udf("string")
    def run(olds, news):
        return olds.combine(news, line_diff)

    return run(old, new)
