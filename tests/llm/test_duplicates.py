import json
import random

from skarn.llm import duplicates

SCHEMA = "id string, content string, low string, raw string, plain string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "c", "c", "c", "c") for a, b in rows], SCHEMA)


def test_formats_and_orders(spark):
    rows = [
        ("a1", "Keep the user sort stable."), ("a2", "keep  THE\tuser-sort  stable"), ("a3", "«Keep the» user sort stable!"), ("a3", "«Keep the» user sort stable!"),
        ("b1", "k=A.b; n=1; z=q"), ("b2", '{"n": "1", "k": "a.B", "z": "Q"}'), ("b3", "- z: q\n- n: 1\n- k: A.b"), ("b4", "k: A.b | n: 1 | z: q"), ("b5", "K = A.B, N = 1, Z = Q"), ("b6", "k ab n 1 z q"),
        ("c1", "k=A.b; n=2; z=q"), ("d1", "Straße"), ("d2", "STRASSE"), ("e1", "!!!"), ("e2", "???"), ("f1", None), (None, "Keep the user sort stable."), ("g1", "x: y"), ("g2", "y: x"),
    ]
    got = {tuple(r) for r in duplicates.members(frame(spark, rows), "id", "content").collect()}
    assert got == {("a1", "a2"), ("a1", "a3"), *{("b1", f"b{i}") for i in range(2, 7)}, ("d1", "d2"), ("e1", "e2")}
    c = {r.keep_id: (r.copies, r.spellings) for r in duplicates.classes(frame(spark, rows), "id", "content").collect()}
    assert c["a1"] == (4, 3) and c["b1"] == (6, 6) and c["c1"] == (1, 1)


def test_random_lists(spark):
    rng = random.Random(4)
    rows, group = [], {}
    for g in range(40):
        pairs = [(f"name_{i}", f"{rng.choice('ABC')}{rng.randint(0, 99)}.x") for i in range(rng.randint(2, 6))]
        pairs[0] = (pairs[0][0], f"unique{g}")
        for k in range(4):
            p = pairs[:]
            rng.shuffle(p)
            text = rng.choice([json.dumps(dict(p)), "; ".join(f"{a}={b}" for a, b in p), " | ".join(f"{a}: {b}" for a, b in p), "\n".join(f"- {a}: {b}" for a, b in p), ", ".join(f"{a} = {b}" for a, b in p), "- " + " - ".join(f"{a}: {b}" for a, b in p)])
            text = rng.choice([str, str.upper, str.lower, lambda s: f"  {s}\n"])(text)
            rows.append((f"{g:02}-{k}", text))
            group[f"{g:02}-{k}"] = f"{g:02}-0"
    got = {(r.keep_id, r.id) for r in duplicates.members(frame(spark, rows), "id", "content").collect()}
    assert got == {(v, k) for k, v in group.items() if v != k}


def test_empty_long_and_hot(spark):
    assert duplicates.members(frame(spark, []), "id", "content").count() == 0
    assert duplicates.classes(frame(spark, []), "id", "content").count() == 0
    rows = [(f"h{i:04}", "same") for i in range(1000)] + [("l1", "word " * 100_000), ("l2", "WORD\n" * 100_000), ("z", "")]
    got = duplicates.members(frame(spark, rows), "id", "content").collect()
    assert len(got) == 1000
