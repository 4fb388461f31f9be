"""Operators over a property graph of symbols: nodes(id, kind, ...) and edges(source, target, kind).

Traversals run level by level: a level joins only its frontier with the edges and leaves out what was reached before.
Each level is written once, so the lineage of a long traversal stays short and a lost executor costs one level. Edges
are a multiset; every operator says whether it counts or ignores repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skarn.session import cut, cut_counted, drop
from skarn.skew import numbered, salted_join


def of_kinds(edges: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    return edges.where(F.col("kind").isin(list(kinds))) if kinds else edges


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct (src, dst) steps along (out), against (in) or both ways."""
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, kinds: Sequence[str] | None = None, direction: str = "out", include_start: bool = True) -> DataFrame:
    """Nodes reached from any seed: (id, depth), depth the least number of steps.

    ``seeds`` has a column id. What was reached is anti-joined by id, frontiers are distinct, so a level moves no more
    rows than edges leave its frontier. Ends when a frontier is empty or ``max_depth`` is reached.
    """
    steps = cut(directed(of_kinds(edges, kinds), direction), "steps")
    frontier = cut(seeds.where("id is not null").select("id").distinct().withColumn("depth", F.lit(0)), "level")
    reached, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        ahead = frontier.select("id").join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier, seen = cut_counted(ahead.join(reached.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if not seen["n"]:
            break
        reached = reached.unionByName(frontier)
    return reached if include_start else reached.where("depth > 0")


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, edge_kinds: Sequence[str] | None = None, node_kinds: Sequence[str] | None = None, direction: str = "out", limit: int | None = None, include_start: bool = True) -> DataFrame:
    """:func:`bfs` whose result, not its way, is narrowed to kinds of nodes; (id, kind, depth), the nearest ``limit`` by id."""
    found = bfs(edges, seeds, max_depth, edge_kinds, direction, include_start).join(nodes.select("id", "kind"), "id")
    found = found.where(F.col("kind").isin(list(node_kinds))) if node_kinds else found
    found = found.select("id", "kind", "depth")
    return found.orderBy("depth", "id").limit(limit) if limit else found


def multi_bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, kinds: Sequence[str] | None = None, direction: str = "out") -> DataFrame:
    """Breadth-first search from each seed apart: (seed, id, depth)."""
    steps = cut(directed(of_kinds(edges, kinds), direction), "steps")
    frontier = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0)), "level")
    reached = frontier
    for depth in range(1, max_depth + 1):
        ahead = frontier.select("seed", "id").join(steps, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        frontier, seen = cut_counted(ahead.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if not seen["n"]:
            break
        reached = reached.unionByName(frontier)
    return reached


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 10, is_directed: bool = False, kinds: Sequence[str] | None = None) -> DataFrame:
    """One shortest path as rows (step, id); of several the one whose predecessors are smallest, from the end back."""
    spark = edges.sparkSession
    steps = cut(directed(of_kinds(edges, kinds), "out" if is_directed else "both"), "steps")
    seen = cut(spark.createDataFrame([(source, None, 0)], "id string, parent string, depth int"), "level")
    frontier, found = seen, source == target
    for depth in range(1, max_depth + 1):
        if found:
            break
        ahead = frontier.select(F.col("id").alias("parent")).join(steps, F.col("parent") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("parent").alias("parent"))
        frontier = cut(ahead.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        found = not frontier.where(F.col("id") == target).isEmpty()
    path, at = [], target if found else None
    while at is not None:  # at most max_depth look-ups
        path.append(at)
        at = seen.where(F.col("id") == at).select("parent").first()[0]
    return spark.createDataFrame([(i, v) for i, v in enumerate(reversed(path))], "step int, id string")


def callers(edges: DataFrame, ids: DataFrame, kind: str = "calls") -> DataFrame:
    e = of_kinds(edges, [kind])
    return e.join(ids.select(F.col("id").alias("target")), "target").select("target", F.col("source").alias("caller")).distinct()


def callees(edges: DataFrame, ids: DataFrame, kind: str = "calls") -> DataFrame:
    e = of_kinds(edges, [kind])
    return e.join(ids.select(F.col("id").alias("source")), "source").select("source", F.col("target").alias("callee")).distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``ids``."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "kind")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: in, out, calls in and out, children. The two ends are counted in one aggregate."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("out"), F.col("kind")), F.struct(F.col("target").alias("id"), F.lit(0).alias("out"), F.col("kind")))).alias("e")).select("e.*")
    n = ends.groupBy("id").agg(
        F.count_if(F.col("out") == 0).alias("in_degree"), F.count_if(F.col("out") == 1).alias("out_degree"),
        F.count_if((F.col("kind") == "calls") & (F.col("out") == 0)).alias("calls_in"), F.count_if((F.col("kind") == "calls") & (F.col("out") == 1)).alias("calls_out"),
        F.count_if((F.col("kind") == "contains") & (F.col("out") == 1)).alias("children"),
    )
    return nodes.select("id").join(n, "id", "left").na.fill(0)


def hotspots(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Nodes of greatest degree without containment; a self-loop counts once."""
    e = edges.where("kind <> 'contains'")
    ends = e.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(n)


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unexported functions, methods and classes that no edge leads to."""
    return nodes.where("not is_exported and kind in ('function', 'method', 'class')").join(edges.select(F.col("target").alias("id")), "id", "left_anti")


def file_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct pairs of files of which one's symbols import the other's."""
    a = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("from_file"))
    b = nodes.select(F.col("id").alias("target"), F.col("file_path").alias("to_file"))
    j = salted_join(salted_join(edges.where("kind = 'imports'").select("source", "target"), a, "source", "inner"), b, "target", "inner")
    return j.where("from_file <> to_file").select("from_file", "to_file").distinct()


def levels(pairs: DataFrame) -> DataFrame:
    """Longest way below each node of an acyclic relation (src, dst): (id, level), level 0 for nodes without dst.

    Round by round, nodes all of whose targets have a level get one more than the greatest of them; what never gets one
    depends on a cycle and has a null level.
    """
    edges = cut(pairs.select("src", "dst").distinct(), "steps")
    ids = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "ids")
    done = cut(ids.join(edges.select(F.col("src").alias("id")), "id", "left_anti").withColumn("level", F.lit(0)), "level")
    last, open_edges, level = done, edges, 0
    while True:
        level += 1
        # Edges into the last level are settled; nodes without open edges are done.
        left = cut(open_edges.join(last.select(F.col("id").alias("dst")), "dst", "left_anti"), "open")
        ready = open_edges.join(last.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(left.select(F.col("src").alias("id")), "id", "left_anti")
        last, seen = cut_counted(ready.withColumn("level", F.lit(level)), "level")
        if not seen["n"]:
            break
        done, open_edges = done.unionByName(last), left
    return ids.join(done, "id", "left")


def depths(parents: DataFrame) -> DataFrame:
    """Longest way to a root over (child, parent) rows: (id, depth); cyclic parts have null."""
    return levels(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).withColumnRenamed("level", "depth")


def components(pairs: DataFrame) -> DataFrame:
    """Weakly connected components of (src, dst): (id, component), component the smallest id.

    Alternating large-star and small-star steps: each round links nodes to smaller ones, ends when nothing changes; the
    number of rounds grows with the logarithm of the component's size, and a node with very many neighbours is
    aggregated with partial results.
    """
    e = cut(pairs.where("src <> dst and src is not null and dst is not null").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    ids = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).where("id is not null").distinct()
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        last = e
        e, seen = cut_counted(large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct(), "cc", F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        drop(last)
        state = (seen["n"], seen["sum"])
        if state == before:
            break
        before = state
    return ids.join(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("low")), "id", "left").select("id", F.coalesce("low", "id").alias("component"))


def smallest_reaching(edges: DataFrame) -> DataFrame:
    """The smallest id that reaches each node of (src, dst), itself included: (id, c).

    A round takes what arrives over the edges and, since whatever reaches a node's colour reaches the node, the colour of
    its colour: the way that is covered about doubles, so rounds are few on long cycles, too.
    """
    colour = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("c", F.col("id")), "colour")
    while True:
        arriving = edges.join(colour, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("low"))
        above = colour.select(F.col("id").alias("c"), F.col("c").alias("up"))
        both = salted_join(colour, above, "c", "inner").join(arriving, "id", "left").select("id", F.least("up", F.coalesce("low", "up")).alias("c"), F.col("c").alias("was"))
        last = colour
        colour, seen = cut_counted(both.select("id", "c", (F.col("c") < F.col("was")).alias("moved")), "colour", F.max("moved").alias("moved"))
        drop(last)
        if not seen["moved"]:
            return colour.select("id", "c")


#: Layers without a way in or out that are trimmed in one job.
LAYERS = 2


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have ways in and out, layer by layer until none goes."""
    before = None
    while True:
        e = edges
        for _ in range(LAYERS):
            ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("back")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("back")))).alias("e")
            keep = e.select(ends).select("e.*").groupBy("id").agg(F.max("out").alias("out"), F.max("back").alias("back")).where("out + back = 2").select("id")
            e = e.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges, seen = cut_counted(e, "scc")
        if seen["n"] in (0, before):  # a job that trims nothing is the last one
            return edges
        before = seen["n"]


def cycles(pairs: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node, or with a self-loop: (component, id).

    Nodes without a way in or out are trimmed first. Then, in rounds, each node takes the smallest id that reaches it (its
    colour). Within a colour, the nodes that reach the colour's own node are those from which it is the smallest node
    reached, since it is the smallest of them all: they form one component, which leaves.
    """
    own = pairs.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    e = cut(pairs.where("src <> dst").select("src", "dst").distinct(), "scc")
    found = []
    while True:
        e = _trimmed(e)
        if e.isEmpty():
            break
        colour = smallest_reaching(e)
        inner = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        back = smallest_reaching(cut(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc"))
        member = cut(colour.join(back.withColumnRenamed("c", "low"), "id", "left").where(F.coalesce("low", "id") == F.col("c")).select("id", F.col("c").alias("component")), "scc")
        found.append(member)
        gone = member.select("id")
        e = cut(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "scc")
    out = own.select("component", "id")
    for m in found:
        out = out.unionByName(m.select("component", "id"))
    sized = out.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    big = out.join(sized.where("n > 1"), "component", "left_semi")
    alone = own.select("component", "id").join(big.select("id"), "id", "left_anti")
    return big.unionByName(alone).distinct()


def _weighted(edges: DataFrame) -> DataFrame:
    """Undirected pairs (a < b) with the number of edges between them."""
    e = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


def label_communities(edges: DataFrame) -> DataFrame:
    """Communities by synchronous label propagation on weighted undirected pairs: (id, community).

    A node takes the label of greatest weight among its neighbours and itself, ties by the smaller label; the order of
    the rows plays no part, so the result is the same on every run. Ends when nothing moves, or when labels come back that
    were there before, as they then would for ever.
    """
    w = _weighted(edges)
    both = cut(w.union(w.select("b", "a", "w")).toDF("id", "n", "w"), "pairs")
    label = cut(both.select("id").distinct().withColumn("l", F.col("id")), "labels")
    known: set = set()
    while True:
        votes = both.join(label.select(F.col("id").alias("n"), "l"), "n").groupBy("id", "l").agg(F.sum("w").alias("w"))
        votes = votes.union(label.select("id", "l", F.lit(1.0).alias("w"))).groupBy("id", "l").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "l")).alias("m")).select("id", F.col("m.l").alias("l2"))
        last = label
        label, seen = cut_counted(
            label.join(best, "id").select("id", F.col("l2").alias("l"), (F.col("l") != F.col("l2")).alias("moved")), "labels", F.max("moved").alias("moved"), F.sum(F.xxhash64("id", "l").cast("decimal(38,0)")).alias("sum")
        )
        drop(last)
        if not seen["moved"] or seen["sum"] in known:
            return label.select("id", F.col("l").alias("community"))
        known.add(seen["sum"])
        label = label.drop("moved")


def _gain(pairs: DataFrame, label: DataFrame, degree: DataFrame, m2: float, resolution: float) -> DataFrame:
    """Each node with the community of a neighbour that raises modularity most, if any does: (id, to)."""
    held = label.join(degree, "id")
    total = held.groupBy("l").agg(F.sum("k").alias("tot"))
    near = pairs.join(label.select(F.col("id").alias("n"), "l"), "n").groupBy("id", "l").agg(F.sum("w").alias("w"))
    # The own community is a candidate, too, though no neighbour may be in it.
    near = near.unionByName(held.select("id", "l", F.lit(0.0).alias("w"))).groupBy("id", "l").agg(F.sum("w").alias("w"))
    own = held.select("id", F.col("l").alias("own"), "k")
    rated = near.join(own, "id").join(total, "l")  # one row a community; the adaptive plan splits a great one
    value = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(F.col("l") == F.col("own"), F.col("k")).otherwise(0.0)) / F.lit(m2)
    best = rated.groupBy("id").agg(F.max(F.when(F.col("l") == F.col("own"), value)).alias("stay"), F.min(F.struct((-value).alias("v"), "l")).alias("m"))
    return best.where(-F.col("m.v") > F.col("stay") + 1e-9).select("id", F.col("m.l").alias("to"))


#: Share of the nodes that may still want to move when a level of communities ends.
SETTLED = 0.05


def _moved(pairs: DataFrame, degree: DataFrame, m2: float, resolution: float) -> DataFrame:
    """Communities after local moves: (id, l). Nodes of one half at a time take the best community of their neighbours.
    Moves at the same time may spoil each other's gains: when the number of moves hasn't fallen for two pairs of rounds, or
    at most SETTLED of the nodes move, they end, and what is left to gain is left to the next level. The result counts only
    if it is better than nodes on their own."""
    alone, n = cut_counted(degree.select("id", F.col("id").alias("l")), "labels")
    label, step, least, idle = alone, 0, float("inf"), 0
    while idle < 2:
        moves = 0
        for _ in range(2):
            turn = F.pmod(F.xxhash64("id", F.lit(step // 2)), F.lit(2)) == step % 2
            wanted = _gain(pairs, label, degree, m2, resolution).where(turn)
            nxt, seen = cut_counted(label.join(wanted, "id", "left").select("id", F.coalesce("to", "l").alias("l"), F.col("to").isNotNull().alias("moved")), "labels", F.count_if("moved").alias("moves"))
            label, step, moves = nxt.select("id", "l"), step + 1, moves + seen["moves"]
        if moves <= SETTLED * n["n"]:
            break
        idle = 0 if moves < least else idle + 1
        least = min(least, moves)
    return label if _quality(pairs, label, degree, m2, resolution) > _quality(pairs, alone, degree, m2, resolution) + 1e-12 else alone


def _quality(pairs: DataFrame, label: DataFrame, degree: DataFrame, m2: float, resolution: float) -> float:
    """Modularity of labels on pairs that are listed from both sides, up to a term that moves don't change."""
    j = pairs.join(label.select("id", F.col("l").alias("a")), "id").join(label.select(F.col("id").alias("n"), F.col("l").alias("b")), "n")
    inside = j.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("x"))
    spread = label.join(degree, "id").groupBy("l").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("y"))
    x, y = inside.withColumn("y", spread.scalar()).first()
    return x / m2 - resolution * (y or 0.0) / m2**2


def communities(edges: DataFrame, resolution: float = 1.0, most: float = 0.25) -> DataFrame:
    """Communities by modularity: (id, community), the community named by its smallest node.

    Nodes move to communities of neighbours while that raises modularity; communities then become the nodes of a smaller
    graph, level by level, until nothing moves. Every community is then refined into its connected parts, and one that
    holds more than ``most`` of all nodes is taken apart again at twice the resolution while that divides it. Edges of a
    node with itself don't count; nodes without other edges belong to nothing.
    """
    w = cut(_weighted(edges), "weights")
    n = w.select(F.explode(F.array("a", "b")).alias("id")).distinct().count()
    if not n:
        return edges.select(F.col("source").alias("id"), F.col("source").alias("community")).limit(0)
    found = cut(_levels(w, resolution), "found")
    while True:
        sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most * n)
        large = [(r[0], r[1]) for r in sizes.collect()]  # at most 1 / most rows
        resolution *= 2
        if not large or resolution > n:
            return found
        own = found.where(F.col("community").isin([c for c, _ in large]))
        inner = w.join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b").where("ca = cb").select("a", "b", "w")
        parts = cut(_levels(inner, resolution), "parts")
        divided = cut(found.join(parts.withColumnRenamed("community", "part"), "id", "left").select("id", F.coalesce("part", "community").alias("community")), "found")
        if divided.select("community").distinct().count() == found.select("community").distinct().count():
            return found
        found = divided


def _levels(w: DataFrame, resolution: float) -> DataFrame:
    """Moves on a graph of weighted pairs and on the graphs of its communities, refined into connected parts."""
    start = w
    node = cut(w.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("l", F.col("id")), "node")
    inner = node.select("id", F.lit(0.0).alias("own"))  # weight inside of a node that stands for a community
    while True:
        pairs = cut(w.union(w.select("b", "a", "w")).toDF("id", "n", "w"), "pairs")
        degree = cut(pairs.groupBy("id").agg(F.sum("w").alias("k")).join(inner, "id", "full_outer").select("id", (F.coalesce("k", F.lit(0.0)) + 2 * F.coalesce("own", F.lit(0.0))).alias("k")), "degree")
        m2 = degree.agg(F.sum("k")).first()[0] or 0.0
        if not m2:
            break
        label = _moved(pairs, degree, m2, resolution)
        if label.where("id <> l").isEmpty():
            break
        node = cut(node.join(label.toDF("l", "up"), "l").select("id", F.col("up").alias("l")), "node")
        j = w.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b")
        weights = cut(j.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")), "weights")
        before = inner.join(label, "id").groupBy(F.col("l").alias("id")).agg(F.sum("own").alias("own"))
        inner = cut(before.unionByName(weights.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("own"))).groupBy("id").agg(F.sum("own").alias("own")), "inner")
        w = weights.where("a <> b")
        if w.isEmpty():
            break
    same = start.join(node.toDF("a", "la"), "a").join(node.toDF("b", "lb"), "b").where("la = lb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = components(same).withColumnRenamed("component", "community")
    return node.select("id").join(parts, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman's modularity of (id, community) labels on the undirected multigraph, as one row."""
    e = edges.where("source <> target").select("source", "target")
    j = e.join(labels.select(F.col("id").alias("source"), F.col("community").alias("ca")), "source").join(labels.select(F.col("id").alias("target"), F.col("community").alias("cb")), "target")
    ends = j.select(F.explode(F.array("ca", "cb")).alias("c"))
    m = j.agg(F.count(F.lit(1)).cast("double").alias("m"), F.count_if(F.col("ca") == F.col("cb")).cast("double").alias("inside"))
    degree = ends.groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return m.withColumn("dd", degree.scalar()).select(F.round(F.try_divide("inside", "m") - F.try_divide(F.col("dd"), 4 * F.col("m") * F.col("m")), 6).alias("modularity"))


def entry_points(nodes: DataFrame, edges: DataFrame, n: int, pattern: str = "(?i)(main|handler|index|init)") -> DataFrame:
    """Routes, then exported functions that nothing calls (by calls made), then names that look like entries."""
    calls = edges.where("kind = 'calls'")
    out = calls.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("fan_out"))
    f = nodes.join(out, "id", "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))
    roots = f.where("is_exported and kind in ('function', 'method')").join(calls.select(F.col("target").alias("id")), "id", "left_anti")
    tiers = [f.where("kind = 'route'").select("id", F.lit(1).alias("tier"), "fan_out"), roots.select("id", F.lit(2).alias("tier"), "fan_out"), f.where(F.col("kind").isin("function", "method") & F.col("name").rlike(pattern)).select("id", F.lit(3).alias("tier"), "fan_out")]
    u = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    return u.groupBy("id").agg(F.min("tier").alias("tier"), F.max("fan_out").alias("fan_out")).orderBy("tier", F.desc("fan_out"), "id").limit(n)


def top_callees(edges: DataFrame, k: int = 5) -> DataFrame:
    """Per caller the ``k`` callees that call most themselves: the pruned graph that flows are traced on."""
    calls = edges.where("kind = 'calls'").select("source", "target").distinct()
    out = calls.groupBy(F.col("source").alias("target")).agg(F.count(F.lit(1)).alias("fan_out"))
    ranked = calls.join(out, "target", "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))
    w = Window.partitionBy("source").orderBy(F.desc("fan_out"), "target")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def flows(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """Longest call flow below each start on the pruned graph: (id, hops, criticality)."""
    pruned = top_callees(edges).select("source", "target", F.lit("calls").alias("kind"))
    reach = multi_bfs(pruned, starts, max_depth)
    hops = reach.groupBy(F.col("seed").alias("id")).agg(F.max("depth").alias("hops"))
    io = nodes.select("id", F.col("name").rlike("(?i)(read|write|fetch|send|save|load|open)").alias("io"))
    score = F.least(F.col("hops") / 10, F.lit(1.0)) * 0.7 + F.when(F.col("io"), 0.3).otherwise(0.0)
    return hops.join(io, "id").where("hops >= 1").select("id", "hops", F.round(score, 4).alias("criticality"))


def surprising(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Edges between distant files, rated by how little of their folders agree and by kind."""
    a = nodes.select(F.col("id").alias("source"), F.split("file_path", "/").alias("pa"))
    b = nodes.select(F.col("id").alias("target"), F.split("file_path", "/").alias("pb"))
    j = salted_join(salted_join(edges.where("kind <> 'contains'").select("source", "target", "kind").distinct(), a, "source", "inner"), b, "target", "inner").where("pa <> pb")
    same: Column = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s.n + F.when(s.go & e, 1).otherwise(0)).alias("n"), (s.go & e).alias("go")), lambda s: s.n)
    weight = F.when(F.col("kind") == "calls", 1.0).when(F.col("kind") == "imports", 0.8).when(F.col("kind") == "extends", 0.9).otherwise(0.5)
    score = F.round((1 - same / F.greatest(F.size("pa"), F.size("pb"))) * weight, 4)
    return j.select("source", "target", "kind", score.alias("score")).orderBy(F.desc("score"), "source", "target", "kind").limit(n)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added and removed by key, in one pass over both sides: (change, keys...)."""
    both = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    g = both.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a")).where("a <> b")
    return g.select(F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"), *keys)


def mutual_calls(edges: DataFrame) -> DataFrame:
    """Direct recursion and pairs that call each other: (a, b, sort)."""
    calls = edges.where("kind = 'calls'").select("source", "target").distinct()
    direct = calls.where("source = target").select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("direct").alias("sort"))
    pair = calls.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return direct.unionByName(pair.select("a", "b", F.lit("mutual").alias("sort")))


def matrix(nodes: DataFrame, edges: DataFrame, part: int, n: int) -> DataFrame:
    """Edge counts between folders of a level, among the first ``n`` folders: (from_dir, to_dir, edges)."""
    folder = F.try_element_at(F.split("file_path", "/"), F.lit(part))
    a = nodes.select(F.col("id").alias("source"), folder.alias("from_dir"))
    b = nodes.select(F.col("id").alias("target"), folder.alias("to_dir"))
    first = F.broadcast(nodes.select(folder.alias("dir")).where("dir is not null").distinct().orderBy("dir").limit(n))
    j = salted_join(salted_join(edges.where("kind <> 'contains'").select("source", "target"), a, "source", "inner"), b, "target", "inner")
    j = j.join(first.withColumnRenamed("dir", "from_dir"), "from_dir", "left_semi").join(first.withColumnRenamed("dir", "to_dir"), "to_dir", "left_semi")
    return j.groupBy("from_dir", "to_dir").agg(F.count(F.lit(1)).alias("edges"))


def coupling(pairs: DataFrame) -> DataFrame:
    """Afferent and efferent coupling and instability of (src, dst) package pairs."""
    ends = pairs.where("src <> dst").distinct().select(F.explode(F.array(F.struct(F.col("src").alias("package"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("package"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    g = ends.groupBy("package").agg(F.count_if(F.col("out") == 0).alias("ca"), F.count_if(F.col("out") == 1).alias("ce"))
    return g.withColumn("instability", F.round(F.coalesce(F.try_divide("ce", F.col("ca") + F.col("ce")), F.lit(0.0)), 4))


def dfs_order(edges: DataFrame, start: str, max_depth: int | None = 10, limit: int | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """Pre-order of a depth-first walk: (position, id). Children go by their id; a node counts where the walk meets it first
    and is not walked again, also where ``max_depth`` ended its way. More than ``limit`` nodes are refused, if it is given.

    The walk meets nodes in the order of their ways from the start (arrays of ids), so a node's way is the least of its
    predecessors' ways with its id behind. Each round takes all ways anew from those of the round before; the rounds end
    when no way changes, after as many as the walk is deep if no node has two predecessors. Then the ways are numbered.
    """
    spark = edges.sparkSession
    steps = cut(directed(of_kinds(edges, kinds)).where(F.col("src").isNotNull() & (F.col("dst") != start)), "steps")
    root = spark.createDataFrame([(start,)], "id string").select("id", F.array("id").alias("way"))
    state = cut(root, "ways")
    while True:
        ways = state.where("way is not null").select("id", "way")
        last = ways if max_depth is None else ways.where(F.size("way") <= max_depth)
        # A step back into the way never is the least one.
        ahead = last.join(steps, (F.col("id") == F.col("src")) & ~F.array_contains("way", F.col("dst"))).select(F.col("dst").alias("id"), F.concat("way", F.array("dst")).alias("way"))
        both = ahead.unionByName(root).withColumn("was", F.lit(None).cast("array<string>")).unionByName(ways.select("id", F.lit(None).cast("array<string>").alias("way"), F.col("way").alias("was")))
        met = both.groupBy("id").agg(F.min("way").alias("way"), F.min("was").alias("was"))
        before = state
        state, seen = cut_counted(met, "ways", F.count("way").alias("ways"), F.count_if(~F.col("way").eqNullSafe(F.col("was"))).alias("moved"))
        drop(before)
        if not seen["moved"]:
            break
    if limit is not None and seen["ways"] > limit:
        raise ValueError(f"more than {limit} nodes are reached")
    return numbered(state.where("way is not null").select("id", "way"), ["way"], "position").select(F.col("position").cast("int").alias("position"), "id")


def context(nodes: DataFrame, edges: DataFrame, ids: DataFrame, each: int = 5) -> DataFrame:
    """Up to ``each`` callers and callees of each symbol, in order of their id: (id, side, other)."""
    calls = edges.where("kind = 'calls'").select("source", "target").distinct()
    one = calls.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("id"), F.lit("caller").alias("side"), F.col("source").alias("other"))
    two = calls.join(ids.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"), F.lit("callee").alias("side"), F.col("target").alias("other"))
    w = Window.partitionBy("id", "side").orderBy("other")
    return one.unionByName(two).withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).drop("k")
