import numpy as np

from skarn.llm import vectors

SCHEMA = "k string, embedding array<float>, created_at bigint, vec_id string, unit string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], t, "c", "c", "c") for k, v, t in rows], SCHEMA)


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 64))
    x = centres[rng.integers(12, size=n)] + rng.standard_normal((n, 64))
    x[: n // 10] = x[n // 10 : 2 * (n // 10)] + 0.15 * rng.standard_normal((n // 10, 64))
    return x


def exact(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    a, b = np.nonzero(np.triu(s >= least, 1))
    return {tuple(sorted((f"k{i:05}", f"k{j:05}"))) for i, j in zip(a, b)}, s


def test_pairs_like_brute_force(spark):
    x = clustered(1500)
    x[7] = x[8] = x[9]  # copies
    df = frame(spark, [(f"k{i:05}", v, 1) for i, v in enumerate(x)])
    index = vectors.build_index(vectors.usable(df, "k"), cell_size=200)
    got = {tuple(sorted((r.id_a, r.id_b))) for r in vectors.named(index, vectors.similar_pairs(index, 0.9), "id_a", "id_b").collect()}
    want, _ = exact(x, 0.9)
    assert got == want and len(want) > 100


def test_blocks_of_a_hot_cell(spark):
    rng = np.random.default_rng(3)
    x = np.ones(64) + 0.6 * rng.standard_normal((400, 64))  # one cluster
    df = frame(spark, [(f"k{i:05}", v, 1) for i, v in enumerate(x)])
    index = vectors.build_index(vectors.usable(df, "k"), cells=1)
    want, s = exact(x, 0.8)
    assert np.abs(s - 0.8).min() > 1e-7
    got = {tuple(sorted((r.id_a, r.id_b))) for r in vectors.named(index, vectors.similar_pairs(index, 0.8, block=70), "id_a", "id_b").collect()}
    assert got == want
    near = vectors.named(index, vectors.nearest(index, 3, block=70), "vec_id", "other").collect()
    assert len(near) == 3 * 400


def test_recall_of_neighbours(spark):
    x = clustered(2000, 5)
    df = frame(spark, [(f"k{i:05}", v, 1) for i, v in enumerate(x)])
    index = vectors.build_index(vectors.usable(df, "k"), cell_size=400)
    got = {}
    for r in vectors.named(index, vectors.nearest(index, 10), "vec_id", "other").collect():
        got.setdefault(r.vec_id, set()).add(r.other)
    _, s = exact(x, 2)
    np.fill_diagonal(s, -1)
    top = np.argsort(-s, 1)[:, :10]
    recall = np.mean([len(got[f"k{i:05}"] & {f"k{j:05}" for j in t}) / 10 for i, t in enumerate(top)])
    assert recall >= 0.9


def test_classes_of_equal_vectors(spark):
    x = clustered(400, 4)
    x[100:300] = x[0]  # half of all rows are one vector
    x[350] = x[351]
    df = frame(spark, [(f"k{i:05}", v * (1 + i % 2), 1) for i, v in enumerate(x)])
    members, pairs = vectors.linked_classes(vectors.usable(df, "k"), 0.9)
    got = {r.vec_key: (r.class_id, r.copies) for r in members.collect()}
    assert len(got) == 400 and {got[f"k{i:05}"] for i in [0, *range(100, 300)]} == {("k00000", 201)} and got["k00351"] == ("k00350", 2)
    want, _ = exact(x, 0.9)
    want = {tuple(sorted((got[a][0], got[b][0]))) for a, b in want}
    assert {tuple(sorted((r.id_a, r.id_b))) for r in pairs.collect()} == {p for p in want if p[0] != p[1]}


def test_unusable_rows(spark):
    v = np.ones(64)
    bad = v.copy()
    bad[3] = np.nan
    inf = v.copy()
    inf[3] = np.inf
    rows = [("a", v, 1), ("a", -v, 2), ("b", v, 1), ("b", v, 1), ("c", v[:32], 5), ("d", v * 0, 1), ("e", bad, 1), ("f", inf, 1), ("g", None, 1), (None, v, 1), ("h", v, 1), ("h", None, 2), ("i", v * 1e-30, 1), ("j", v * 3e37, 1)]
    keys = {r.vec_key for r in vectors.usable(frame(spark, rows), "k").collect()}
    assert keys == {"a", "b", "i", "j"}
    index = vectors.build_index(vectors.usable(frame(spark, []), "k"))
    assert vectors.similar_pairs(index, 0.9).count() == 0 and vectors.nearest(index).count() == 0


def test_error_bound_holds():
    """The estimates that the queries use, of vectors that aren't centred on the cell's centroid."""
    rng = np.random.default_rng(1)
    turn, c = vectors.rotation(64), rng.standard_normal(64) / 12
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 64)) + 8 * c)
    x, q = unit(3000), unit(60)
    rx, rq = (x - c) @ turn, (q - c) @ turn
    est, (norm, dev) = vectors.scores(vectors.encode(rx), rq, rq @ (c @ turn), rx @ (c @ turn), float(c @ c))
    z = (est - q @ x.T) / (norm[:, None] * dev)
    assert (np.abs(z) <= vectors.WIDTH).mean() > 0.999 and abs(z.mean()) < 0.1 and 0.5 < z.std() < 1.5


def test_bounds_choose_what_is_compared():
    """Within one cell the neighbours are those of the exact products, though rows that no bound reaches are left out."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    near = rng.standard_normal((200, 64)) * 0.5 + np.eye(64)[0] * 4
    x = np.concatenate((near, rng.standard_normal((1800, 64)) * 0.5 - np.eye(64)[0] * 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = pa.table({"cell": [0] * 2000, "vec_id": np.arange(2000), "unit": [v.tobytes() for v in x], "i": [0] * 2000, "j": [0] * 2000, "own": [0] * 2000})

    class Shared:
        value = np.zeros((1, 64), np.float32)

    out = vectors._nearest_fn(Shared, 64, 10)(t).to_pandas()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = [set(r) for r in np.argsort(-s, 1)[:, :10]]
    got = out.groupby("vec_id").other.agg(set)
    assert out.groupby("vec_id").size().eq(10).all() and np.mean([len(got[i] & w) / 10 for i, w in enumerate(want)]) > 0.97


def test_pairs_meet_in_the_cell_of_their_middle(spark):
    """Pairs near the least cosine whose vectors lie between many cells."""
    rng = np.random.default_rng(7)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d = rng.standard_normal((600, 64))
    d -= (d * a).sum(1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    x = np.concatenate((a, 0.905 * a + np.sqrt(1 - 0.905**2) * d))
    index = vectors.build_index(vectors.usable(frame(spark, [(f"k{i:05}", v, 1) for i, v in enumerate(x)]), "k"), cells=40)
    got = {(r.id_a, r.id_b) for r in vectors.named(index, vectors.similar_pairs(index, 0.9), "id_a", "id_b").select("id_a", "id_b").collect()}
    assert len({tuple(sorted(p)) for p in got} & {(f"k{i:05}", f"k{i + 600:05}") for i in range(600)}) >= 598
