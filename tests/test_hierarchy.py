from skarn.operators import hierarchy

SCHEMA = "id string, parent_id string, updated_at bigint, depth string, path string, salt string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, t, "x", "y", "z") for a, b, t in rows], SCHEMA)


def test_paths_depths_loops_and_descendants(spark):
    rows = [
        ("r", None, 1), ("a", "r", 1), ("b", "a", 1), ("c", "b", 1), ("e", "", 1), ("f", "gone", 1),  # trees
        ("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("h", "z", 1), ("i", "h", 1),  # a loop with a tail
        ("s", "s", 1), ("t", "s", 1),  # its own parent
        ("m", "x", 1), ("m", "r", 2), ("m", "r", 2),  # the later row counts, repeated rows once
        (None, "r", 1), (None, None, 3),
    ]
    h = hierarchy.build(frame(spark, rows))
    got = {r.id: (r.root_id, r.depth, list(r.path)) for r in h.reached.collect()}
    assert got == {
        "r": ("r", 0, ["r"]), "a": ("r", 1, ["r", "a"]), "b": ("r", 2, ["r", "a", "b"]), "c": ("r", 3, ["r", "a", "b", "c"]), "e": ("e", 0, ["e"]), "f": ("f", 0, ["f"]), "m": ("r", 1, ["r", "m"]),
    }
    assert {tuple(r) for r in h.cycles().collect()} == {("x", "x"), ("x", "y"), ("x", "z"), ("s", "s")}
    assert {tuple(r) for r in h.descendants().collect()} == {("r", "a", 1), ("r", "b", 2), ("a", "b", 1), ("r", "c", 3), ("a", "c", 2), ("b", "c", 1), ("r", "m", 1)}


def test_empty_table_and_hot_parent(spark):
    h = hierarchy.build(frame(spark, []))
    assert h.reached.count() == 0 and h.cycles().count() == 0
    rows = [("root", None, 1)] + [(f"c{i}", "root", 1) for i in range(300)] + [(f"d{i}", f"c{i}", 1) for i in range(50)]
    h = hierarchy.build(frame(spark, rows), with_paths=False)
    assert h.reached.groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 300), (2, 50)]


def test_many_loops_of_even_and_odd_length(spark):
    rows = [(f"{n}-{i:02}", f"{n}-{(i + 1) % n:02}", 1) for n in (1, 2, 3, 4, 6, 8, 13) for i in range(n)]
    rows += [("t0", "8-03", 1), ("t1", "t0", 1), ("t2", "t1", 1)]
    got = {tuple(r) for r in hierarchy.build(frame(spark, rows)).cycles().collect()}
    assert got == {(f"{n}-00", f"{n}-{i:02}") for n in (1, 2, 3, 4, 6, 8, 13) for i in range(n)}
