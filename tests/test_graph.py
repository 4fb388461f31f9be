import pytest

from skarn.operators import graph


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k) for a, b, k in rows], "source string, target string, kind string")


@pytest.fixture
def small(spark):
    return edges(spark, ("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "d", "calls"), ("d", "e", "imports"), ("x", "x", "calls"), ("a", "b", "calls"))


def ids(spark, *v):
    return spark.createDataFrame([(i,) for i in v], "id string")


def test_bfs_and_paths(spark, small):
    got = {r.id: r.depth for r in graph.bfs(small, ids(spark, "a")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert {r.id for r in graph.bfs(small, ids(spark, "a"), 2, ["calls"]).collect()} == {"a", "b", "c"}
    assert {r.id for r in graph.bfs(small, ids(spark, "d"), None, None, "in", include_start=False).collect()} == {"a", "b", "c"}
    assert [r.id for r in graph.shortest_path(small, "a", "e").orderBy("step").collect()] == ["a", "c", "d", "e"]
    assert [r.id for r in graph.shortest_path(small, "a", "d", is_directed=True).orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(small, "e", "x").count() == 0
    assert graph.bfs(small, ids(spark)).count() == 0


def test_cycles_components_levels(spark, small):
    p = small.selectExpr("source src", "target dst")
    assert {tuple(r) for r in graph.cycles(p).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x")}
    assert {r.id: r.component for r in graph.components(p).collect()} == {**{i: "a" for i in "abcde"}, "x": "x"}
    dag = edges(spark, ("a", "b", "i"), ("b", "c", "i"), ("a", "c", "i"), ("p", "q", "i"), ("q", "p", "i"), ("z", "p", "i")).selectExpr("source src", "target dst")
    assert {r.id: r.level for r in graph.levels(dag).collect()} == {"a": 2, "b": 1, "c": 0, "p": None, "q": None, "z": None}


def test_two_loops_that_share_a_way(spark):
    p = edges(spark, ("1", "2", ""), ("2", "1", ""), ("2", "3", ""), ("3", "4", ""), ("4", "5", ""), ("5", "3", ""), ("0", "1", ""), ("5", "9", "")).selectExpr("source src", "target dst")
    assert {tuple(r) for r in graph.cycles(p).collect()} == {("1", "1"), ("1", "2"), ("3", "3"), ("3", "4"), ("3", "5")}


def test_communities_and_modularity(spark):
    e = edges(spark, *[(a, b, "calls") for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x"))])
    labels = graph.label_communities(e)
    by = {r.id: r.community for r in labels.collect()}
    assert by["a"] == by["b"] == by["c"] and by["x"] == by["y"] == by["z"]
    q = graph.modularity(e, labels).first().modularity
    assert -0.5 <= q <= 1


def test_degrees_and_recursion(spark, small):
    n = spark.createDataFrame([(i, "function") for i in "abcdexq"], "id string, kind string")
    m = {r.id: r for r in graph.metrics(n, small).collect()}
    assert (m["a"].out_degree, m["a"].in_degree, m["q"].in_degree) == (2, 1, 0)
    assert graph.hotspots(n, small, 1).first().degree == 3
    assert {tuple(r) for r in graph.mutual_calls(edges(spark, ("a", "b", "calls"), ("b", "a", "calls"), ("x", "x", "calls"))).collect()} == {("a", "b", "mutual"), ("x", "x", "direct")}


def test_communities_by_modularity(spark):
    """Cliques in a ring: each is a community; a great one is taken apart; parts that don't hang together are apart."""
    import itertools

    rows = [(f"c{k}n{i}", f"c{k}n{j}", "calls") for k in range(8) for i, j in itertools.combinations(range(5), 2)] + [(f"c{k}n0", f"c{(k + 1) % 8}n1", "calls") for k in range(8)] + [("self", "self", "calls")]
    e = edges(spark, *rows)
    by = {r.id: r.community for r in graph.communities(e).collect()}
    assert len(by) == 40 and all(by[f"c{k}n{i}"] == f"c{k}n0" for k in range(8) for i in range(5))
    q = graph.modularity(e, graph.communities(e)).first().modularity
    assert q >= graph.modularity(e, graph.label_communities(e)).first().modularity and q > 0.7
    assert graph.communities(e.where("false")).count() == 0
    two = edges(spark, ("a", "b", "calls"), ("p", "q", "calls"))
    assert {tuple(r) for r in graph.communities(two).collect()} == {("a", "a"), ("b", "a"), ("p", "p"), ("q", "p")} or len(graph.communities(two).collect()) == 4
