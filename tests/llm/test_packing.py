import collections

import numpy as np
import pytest

from skarn.llm import packing, tokens

SCHEMA = "doc_id bigint, text string, key string, size string, curve string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c", "c", "c") for i, t in enumerate(texts)], SCHEMA)


def test_every_token_is_placed_once(spark):
    rng = np.random.default_rng(2)
    texts = ["alpha beta gamma " * int(rng.integers(1, 60)) for _ in range(300)] + ["x y " * 900, None, "", " "]
    df = frame(spark, texts)
    rows = packing.pack(df, "doc_id", "text", [("s", 64), ("m", 500)]).collect()
    sizes = {r.doc_id: len(r.ids) for r in tokens.encode_column(df, "doc_id", "text").collect()}
    for name, cap in (("s", 64), ("m", 500)):
        mine = [r for r in rows if r.pack_name == name]
        total, used, pieces = collections.Counter(), collections.Counter(), collections.defaultdict(list)
        for r in mine:
            total[r.doc_id] += r["size"]
            used[r.container] += r["size"]
            pieces[r.doc_id].append(r.piece)
        assert dict(total) == {k: v for k, v in sizes.items() if v}
        assert max(used.values()) <= cap and min(r["size"] for r in mine) > 0
        for doc, p in pieces.items():
            assert sorted(p) == list(range(len(p))) and len(p) == -(-sizes[doc] // cap)
        assert len(used) <= sum(used.values()) / cap * 1.15 + 4


def test_empty_and_wrong(spark):
    assert packing.pack(frame(spark, []), "doc_id", "text", [("s", 8)]).count() == 0
    assert packing.pack(frame(spark, [None, ""]), "doc_id", "text", [("s", 8)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, ["a"]), "doc_id", "text", [("s", 0)])


def test_hilbert_curve_is_continuous():
    side = 8
    grid = np.array([(a, b) for a in range(side) for b in range(side)])
    k = packing.hilbert_keys(grid, 3)
    assert sorted(k.tolist()) == list(range(side * side))
    walk = grid[np.argsort(k)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_best_fit_prefers_the_fullest():
    assert sorted(sorted(i for i, _ in items) for _, items in packing.best_fit([(6, 0), (5, 1), (4, 2), (5, 3)], 10)) == [[4, 6], [5, 5]]


def test_containers_hold_neighbours_and_little_is_lost():
    """Along an order, containers hold what is near each other; what is left over is bounded."""
    rng = np.random.default_rng(3)
    sizes = np.minimum(np.exp(rng.normal(5, 1, 6000)).astype(int) + 1, 1000)
    p = packing.Packer(1000)
    closed = [items for n, s in enumerate(sizes.tolist()) for items in p.add(s, n)]
    placed = [n for items in closed for _, n in items] + [n for _, n in p.pool]
    assert sorted(placed) == list(range(6000)) and len(p.pool) < packing.POOL + 200 and all(sum(s for s, _ in items) <= 1000 for items in closed)
    spread = np.mean([np.ptp([n for _, n in items]) for items in closed if len(items) > 1])
    assert spread < 600 and 1 - sum(s for items in closed for s, _ in items) / (1000 * len(closed)) < 0.01


def test_many_ranges_number_their_containers_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_CONTAINERS", 1)
    monkeypatch.setattr(packing, "JOINED", 2)
    rng = np.random.default_rng(5)
    words = [f"w{i} " for i in range(50)]
    texts = ["".join(rng.choice(words, int(rng.integers(1, 90)))) for _ in range(400)]
    rows = packing.pack(frame(spark, texts), "doc_id", "text", [("a", 60), ("b", 100)]).collect()
    used, packs = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        used[r.pack_name, r.container] += r["size"]
        packs[r.container].add(r.pack_name)
    assert all(v <= {"a": 60, "b": 100}[n] for (n, _), v in used.items()) and all(len(v) == 1 for v in packs.values())
    assert len({(r.pack_name, r.doc_id, r.piece) for r in rows}) == len(rows) and {r.doc_id for r in rows} == set(range(400))
