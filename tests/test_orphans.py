from skarn.operators import orphans

REF = "owner string, qualified_name string, created_at bigint, ref_table string, name string, refs string"
NODE = "id string, qualified_name string, updated_at bigint, removed_at bigint, last string"


def found(spark, refs, nodes):
    r = spark.createDataFrame([(*x, "c", "c", "c") for x in refs], REF)
    n = spark.createDataFrame([(*x, "c") for x in nodes], NODE)
    s = orphans.reference_state(orphans.reference_deltas(r, "t", "owner"))
    e = orphans.existence_state(orphans.existence_deltas(n))
    return {tuple(x)[:4] for x in orphans.orphans(s, e).collect()}


def test_reasons(spark):
    refs = [("o1", "gone", 5), ("o1", " gone\t", 4), ("o1", "dead", 5), ("o1", "late", 5), ("o2", "late", 50), ("o1", "here", 5), ("o1", None, 1), ("o1", "\u00a0 ", 1), (None, "gone", 1), ("o3", "GONE", 1), ("o4", "tie", 9), ("o5", "here", None)]
    nodes = [("1", "dead", 1, None), ("1", "dead", 2, 2), ("2", "late", 10, None), ("3", "here", 1, None), ("3", "here", 2, 2), ("4", "here", 3, None), ("5", None, 1, None), ("6", "tie", 1, 1), ("7", "tie", 1, None)]
    assert found(spark, refs, nodes) == {("t", "o1", "gone", "missing"), ("t", None, "gone", "missing"), ("t", "o3", "GONE", "missing"), ("t", "o1", "dead", "deleted"), ("t", "o1", "late", "late")}


def test_empty_sides_and_hot_name(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [], [("1", "a", 1, None)]) == set()
    hot = [(f"o{i}", "hot", 1) for i in range(500)]
    assert len(found(spark, hot + [("x", "ok", 9)], [("1", "ok", 1, None)])) == 500


def test_deltas_merge_into_a_state(spark):
    r = spark.createDataFrame([("o", "a", 5, "", "", "")], REF)
    s1 = orphans.reference_state(orphans.reference_deltas(r, "t", "owner"))
    withdrawn = orphans.reference_state(s1, orphans.reference_deltas(r, "t", "owner", sign=-1))
    none = spark.createDataFrame([], NODE)
    assert orphans.orphans(s1, orphans.existence_state(orphans.existence_deltas(none))).count() == 1
    assert orphans.orphans(withdrawn, orphans.existence_state(orphans.existence_deltas(none))).count() == 0


def test_report_by_month(spark):
    r = spark.createDataFrame([("o", "a", 1735689600000, "", "", ""), ("p", "a", 1735689600001, "", "", ""), ("q", "b", 1738368000000, "", "", "")], REF)
    f = orphans.orphans(orphans.reference_state(orphans.reference_deltas(r, "t", "owner")), orphans.existence_state(orphans.existence_deltas(spark.createDataFrame([], NODE))))
    assert {tuple(x) for x in orphans.orphan_report(f).collect()} == {("t", "2025-01", "missing", 2, 1), ("t", "2025-02", "missing", 1, 1)}
