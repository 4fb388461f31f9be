"""Most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors are gathered into cells around centroids that are fitted on a bounded sample. For pairs of a least cosine a vector
is put into every cell in which the middle between it and a partner may lie (:func:`pair_margin`), for neighbours into all
cells about as near as its nearest one. Within a cell, the direction of a vector from the centroid is rotated at random and kept as one
bit per dimension with two correction scalars (distance from the centroid, inner product of code and direction). Inner
products of a query with all codes are estimated from its 4-bit quantised coordinates by AND and popcount; the error
bound of the estimate decides which vectors are compared exactly. Cells beyond ``block`` rows are cut into blocks, and
every pair of blocks is a task of its own, so a cell with a third of all rows doesn't end in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skarn.session import cut, drop
from skarn.skew import hashed_sample, salted_join

#: Rows, about, on which centroids are fitted (a bounded sample; every row is indexed).
SAMPLE = 20_000
#: Bits of the quantised query.
QUERY_BITS = 4
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 4.0
#: Deviations by which a vector may lie nearer to its own centroid than to that of the cell where it meets a partner.
MARGIN = 3.0
#: The same for neighbours, as a share of the distance of the two centroids: the greater it is, the greater the recall.
NEAR_MARGIN = 0.09
#: Deviations by which an estimate may lie below the k-th exact product for its vector to be compared exactly.
NEAR_WIDTH = 1.0
#: Rows of a cell's block at most (per side of a task).
BLOCK = 16_000
#: Queries that are estimated at a time: their arrays shall stay in the processor's cache.
ROWS = 48
#: Columns whose greatest lower bound stands for them when the k-th is sought.
GROUP = 16


def usable(df: DataFrame, key: str, vector: str = "embedding", updated: str | None = "created_at", dim: int = 64) -> DataFrame:
    """Current row per key with ``dim`` finite numbers that are not all zero: (vec_key, unit: packed float32).

    Null keys and null vectors don't count; the greatest ``updated`` counts, equal ones are settled by the vector.
    """
    at = F.col(updated) if updated else F.lit(0)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("vec_key"), F.struct(at.alias("at"), F.col(vector).alias("v")).alias("s"))
    current = rows.groupBy("vec_key").agg(F.max("s").alias("s")).select("vec_key", F.col("s.v").alias("v")).where(F.size("v") == dim)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(invalid="ignore", over="ignore"):
                top = np.abs(x).max(axis=1)
                ok = np.isfinite(x).all(axis=1) & (top > 0)
                x = x[ok] / top[ok, None]
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            raw = pa.Array.from_buffers(pa.binary(dim * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, "<f4").tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), raw], ["vec_key", "unit"])

    return current.mapInArrow(unit, "vec_key string, unit binary")


def matrix(col, dim: int) -> np.ndarray:
    """Rows of packed float32 as a matrix."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.binary())
    if not len(arr):
        return np.zeros((0, dim), np.float32)
    first = arr.offset
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if pa.types.is_large_binary(arr.type) else np.int32)
    start = int(offsets[first])
    return np.frombuffer(arr.buffers()[2], np.float32, count=len(arr) * dim, offset=start).reshape(-1, dim)


def fit_centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with fixed seed; empty cells keep their first member."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].astype(np.float32).copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.append(True, near[order][1:] != near[order][:-1]))
        c[near[order][at]] = np.add.reduceat(x[order], at, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass(frozen=True)
class Codes:
    """One-bit codes of directions from a centroid, as a matrix of words, and the correction scalars."""

    bits: np.ndarray  # uint64, rows x words
    norm: np.ndarray  # distance from the centroid
    inner: np.ndarray  # inner product of code and direction
    ones: np.ndarray  # number of set bits


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def pack_bits(b: np.ndarray) -> np.ndarray:
    pad = -b.shape[1] % 64
    if pad:
        b = np.pad(b, ((0, 0), (0, pad)))
    return np.packbits(b, axis=1, bitorder="little").view(np.uint64)


def encode(rotated: np.ndarray) -> Codes:
    """Codes of rotated differences from the centroid."""
    norm = np.linalg.norm(rotated, axis=1)
    safe = np.maximum(norm, 1e-12)
    d = rotated.shape[1]
    inner = np.abs(rotated).sum(1) / (math.sqrt(d) * safe)
    bits = pack_bits(rotated > 0)
    return Codes(bits, norm, np.maximum(inner, 1e-3), np.bitwise_count(bits).sum(1).astype(np.int32))


def plane_sums(bits: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Sums over the set bits of each code of the queries' QUERY_BITS-bit levels (queries x codes), by AND and popcount."""
    if bits.shape[1] == 1:  # up to 64 dimensions: pairs of planes stay below 256 and add up in bytes
        words = bits[None, :, 0]
        halves = []
        for j in range(0, QUERY_BITS, 2):
            low = np.bitwise_count(words & pack_bits((level >> j) & 1)[:, 0, None])
            high = np.bitwise_count(words & pack_bits((level >> (j + 1)) & 1)[:, 0, None])
            high <<= 1
            low += high
            halves.append(low)
        acc = halves[1].astype(np.float32)
        acc *= 4
        acc += halves[0]
        return acc
    acc = np.zeros((len(level), len(bits)), np.float32)
    for j in range(QUERY_BITS):
        plane = pack_bits((level >> j) & 1)
        for w in range(plane.shape[1]):
            acc += np.bitwise_count(bits[None, :, w] & plane[:, w, None]).astype(np.float32) * (1 << j)
    return acc


def quantise(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """QUERY_BITS-bit levels of each row's coordinates, the step and the least coordinate."""
    low = q.min(1)
    step = np.maximum((q.max(1) - low) / (2**QUERY_BITS - 1), 1e-12)
    return np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8), step, low


def deviation(codes: Codes, dim: int, step: float) -> np.ndarray:
    """Standard deviation per code of the estimate between unit directions: of the code and of the query's rounding."""
    spread = np.sqrt((1 - np.minimum(codes.inner, 1) ** 2) / (codes.inner**2 * max(dim - 1, 1)))
    return np.sqrt(spread**2 + (step / math.sqrt(12) / codes.inner) ** 2)


def scores(codes: Codes, r: np.ndarray, rc_q: np.ndarray, rc_c: np.ndarray, cc: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Estimated inner products of vectors (queries x codes) and their standard deviation as a product of two factors.

    r: rotated differences of the queries from the centroid c. <x, y> = |x-c||y-c| <dx, dy> + <x-c, c> + <y-c, c> + <c, c>;
    all but the popcounts is of low rank, so that it is one small matrix product.
    """
    d = r.shape[1]
    norm = np.maximum(np.linalg.norm(r, axis=1), 1e-12)
    level, step, low = quantise(r / norm[:, None])
    w = (codes.norm / (codes.inner * math.sqrt(d))).astype(np.float32)
    total = level.sum(1) * step + low * d
    mid = plane_sums(codes.bits, level)
    mid *= w
    mid *= (2 * norm * step).astype(np.float32)[:, None]
    one = np.ones(len(w), np.float32)
    left = np.stack((2 * norm * low, -norm * total, rc_q + cc, np.ones(len(r))), 1).astype(np.float32)
    mid += left @ np.stack((codes.ones * w, w, one, rc_c.astype(np.float32)))
    dev = codes.norm * deviation(codes, d, float(step.mean()) if len(r) else 0.0)
    return mid, (norm.astype(np.float32), dev.astype(np.float32))


def _cells(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


@dataclass
class Index:
    """Cells of all vectors: ``rows`` has (vec_id, vec_key, unit), written once; ``centroids`` were fitted on a sample."""

    rows: DataFrame
    centroids: np.ndarray
    n: int
    dim: int


def build_index(vectors: DataFrame, dim: int = 64, cell_size: int | None = 800, cells: int | None = None) -> Index:
    """Number the rows, write them, and fit centroids: about n / cell_size of them, at most a fifth of the sample.

    Without a cell_size the number of cells is a quarter of the root of n: for neighbours at any distance, whose cells must
    not become so many that the nearest few hold too little of a vector's surroundings.
    """
    rows = cut(vectors.withColumn("vec_id", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    picked = hashed_sample(rows, ["vec_key"], SAMPLE, n).select("vec_key", "unit").toArrow().sort_by("vec_key").select(["unit"]) if n else None
    x = matrix(picked.column(0), dim).astype(np.float32) if n else np.zeros((0, dim), np.float32)
    k = min(cells or (_cells(n, cell_size) if cell_size else math.ceil(math.sqrt(n) / 4)), max(1, len(x) // 5))
    return Index(rows, fit_centroids(x, k) if n else np.zeros((0, dim), np.float32), n, dim)


def pair_margin(least: float, dim: int) -> float:
    """How much nearer, as a share of the distance of two centroids, a vector may lie to its own one when it shares the
    other one's cell with the middle between it and a partner of a cosine of at least ``least``.

    Two unit vectors of that cosine are at most d = 2 sin(acos(least) / 4) away from their middle m. Let c be the centroid
    nearest to m, and o that nearest to one of them, x. Then <m, c - o> >= 0, so that <x, o - c> <= <x - m, o - c>, whose
    deviation for a direction that knows nothing of the centroids is d |o - c| / sqrt(dim). MARGIN deviations are allowed.
    """
    return MARGIN * 2 * math.sin(math.acos(max(-1.0, min(1.0, least))) / 4) / math.sqrt(dim)


def place(index: Index, margin: float) -> DataFrame:
    """Each vector once for each of its cells: (cell, vec_id, unit). They are that of its nearest centroid o and those of
    all centroids c with <x, o - c> at most ``margin`` |o - c|, however many these are: a vector well within a cell has one,
    one between many cells has many."""
    shared, dim = index.rows.sparkSession.sparkContext.broadcast(index.centroids), index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        apart = margin * np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                x = matrix(b.column(1), dim)
                g = x @ c.T
                own = g.argmax(1)
                at, cell = np.nonzero(g >= g[np.arange(len(x)), own][:, None] - apart[own] - 1e-6)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], ["cell", "vec_id", "unit"])

    return index.rows.select("vec_id", "unit").mapInArrow(run, "cell int, vec_id bigint, unit binary")


def tasks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with the pair of blocks (i <= j) of their cell in which they are compared; ``side`` is i or j.

    The number of blocks of a cell follows its size, which is counted over all rows; it stays one for most cells.
    """
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    row = placed.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return row.select("cell", "vec_id", "unit", "own", other.alias("with")).select(
        "cell", "vec_id", "unit", F.least("own", "with").cast("int").alias("i"), F.greatest("own", "with").cast("int").alias("j"), F.col("own").cast("int").alias("own")
    )


def _task(t: pa.Table, centroids: np.ndarray, turn: np.ndarray):
    dim = centroids.shape[1]
    x = matrix(t.column("unit"), dim)
    ids = t.column("vec_id").to_numpy()
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    own = t.column("own").to_numpy()
    c = centroids[t.column("cell")[0].as_py()]
    r = (x - c) @ turn
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    return x, ids, r, r @ (c @ turn), left, right, i == j, c


def _pairs_fn(centroids, dim: int, least: float):
    turn = rotation(dim)

    def run(t: pa.Table) -> pa.Table:
        x, ids, r, rc, left, right, same, c = _task(t, centroids.value, turn)
        codes = encode(r[right])
        cc = float(c @ c)
        out_a, out_b, out_s = [], [], []
        for s in range(0, len(left), ROWS):
            at = left[s : s + ROWS]
            top, (norm, dev) = scores(codes, r[at], rc[at], rc[right], cc)
            top += norm[:, None] * (WIDTH * dev)
            a, b = np.divmod(np.flatnonzero(top >= least), top.shape[1])
            a, b = at[a], right[b]
            keep = (ids[a] < ids[b]) if same else (ids[a] != ids[b])
            a, b = a[keep], b[keep]
            exact = np.einsum("ij,ij->i", x[a].astype(np.float64), x[b].astype(np.float64))
            ok = exact >= least - 1e-7  # rounding of the packed units
            out_a.append(np.minimum(ids[a[ok]], ids[b[ok]]))
            out_b.append(np.maximum(ids[a[ok]], ids[b[ok]]))
            out_s.append(exact[ok])
        cat = lambda v, k: np.concatenate(v) if v else np.zeros(0, k)
        return pa.table({"id_a": pa.array(cat(out_a, np.int64), pa.int64()), "id_b": pa.array(cat(out_b, np.int64), pa.int64()), "cosine": pa.array(cat(out_s, np.float64), pa.float64())})

    return run


def similar_pairs(index: Index, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs (id_a < id_b, cosine) with cosine of at least ``least``, however many partners a vector has."""
    shared = index.rows.sparkSession.sparkContext.broadcast(index.centroids)
    found = tasks(place(index, pair_margin(least, index.dim)), block).groupBy("cell", "i", "j").applyInArrow(_pairs_fn(shared, index.dim, least), "id_a bigint, id_b bigint, cosine double")
    return found.groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))


def linked_classes(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as classes: members (vec_key, class_id, copies) and pairs of classes (id_a, id_b, cosine), which name
    them by their smallest key. However many copies a vector has, it is compared once."""
    kept = cut(vectors, "usable")
    # Only the kept vector of each class is moved whole; keys find their class by the digest of the vector.
    whole = kept.groupBy("unit").agg(F.min("vec_key").alias("class_id"))
    index = build_index(whole.select(F.col("class_id").alias("vec_key"), "unit"))
    pairs = named(index, similar_pairs(index, least), "id_a", "id_b")
    keys = cut(kept.select("vec_key", F.unhex(F.sha2("unit", 256)).alias("digest")), "keys")
    drop(kept)  # the index has its own copy of what is compared
    classes = keys.groupBy("digest").agg(F.min("vec_key").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return salted_join(keys, classes, "digest", "inner").select("vec_key", "class_id", "copies"), pairs


def links_of(pairs: DataFrame) -> DataFrame:
    """(class_id, links): number of partners."""
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id"))
    return ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))


def _least_top(m: np.ndarray, k: int) -> np.ndarray:
    """Per row a value that at least ``k`` columns reach: the k-th of the greatest values of groups of columns, or the
    k-th value itself in short rows; the least float where there are fewer columns than that."""
    n = m.shape[1]
    groups = n // GROUP
    if groups > 4 * k:
        m, n = m[:, : groups * GROUP].reshape(len(m), GROUP, groups).max(1), groups
    if n <= k:
        return np.full(len(m), np.finfo(np.float32).min, np.float32)
    return np.partition(m, n - k, axis=1)[:, n - k]


def _compared(wanted: np.ndarray, x: np.ndarray, at: np.ndarray, ds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact products of the wanted (query, row) pairs, a row with itself left out: (query's place in at, row, product)."""
    a, b = np.divmod(np.flatnonzero(wanted), wanted.shape[1])
    b = ds[b]
    keep = at[a] != b
    a, b = a[keep], b[keep]
    return a, b, np.einsum("ij,ij->i", x[at[a]], x[b])


def _kth(a: np.ndarray, e: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th greatest value per query; the least float where a query has fewer."""
    order = np.lexsort((-e, a))
    a, e = a[order], e[order]
    first = np.searchsorted(a, np.arange(n))
    out = np.full(n, np.finfo(np.float32).min, np.float32)
    has = np.searchsorted(a, np.arange(n), side="right") - first >= k
    out[has] = e[first[has] + k - 1]
    return out - 1e-6


def _nearest_fn(centroids, dim: int, k: int):
    turn = rotation(dim)

    def run(t: pa.Table) -> pa.Table:
        x, ids, r, rc, left, right, same, c = _task(t, centroids.value, turn)
        cc = float(c @ c)
        res: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for qs, ds in ((left, right),) if same else ((left, right), (right, left)):
            codes, turned, every = encode(r[ds]), np.ascontiguousarray(x[ds].T), np.arange(len(ds))
            for s in range(0, len(qs), ROWS):
                at = qs[s : s + ROWS]
                mid, (norm, dev) = scores(codes, r[at], rc[at], rc[ds], cc)
                # The best estimates are compared exactly first: the k-th of these products is a floor for all others.
                a, b, e = _compared(mid >= _least_top(mid, k + 1)[:, None], x, at, ds)
                floor = _kth(a, e, len(at), k)
                # Then the vectors whose upper bound reaches the floor. Those that no query of the group wants are left out
                # of the product if they are many; within it a mask costs less than to gather pair by pair.
                mid += norm[:, None] * (NEAR_WIDTH * dev)
                mid -= floor[:, None]
                wanted = np.flatnonzero(mid.max(0) >= 0)
                if len(wanted) > 0.75 * len(ds):
                    wanted, exact = every, x[at] @ turned
                else:
                    mid, exact = mid[:, wanted], x[at] @ x[ds[wanted]].T
                exact[mid < 0] = -2
                if same:
                    exact[at[:, None] == ds[wanted]] = -2
                few = np.maximum(_least_top(exact, k), np.float32(-1.5))
                a, b = np.divmod(np.flatnonzero(exact >= few[:, None]), len(wanted))
                e = exact[a, b]
                a, b = at[a], ds[wanted[b]]
                order = np.lexsort((ids[b], -e, a))
                a, b, e = a[order], b[order], e[order]
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
                rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
                top = rank < k
                res.append((ids[a[top]], ids[b[top]], e[top].astype(np.float64)))
        cat = lambda i, k: np.concatenate([v[i] for v in res]) if res else np.zeros(0, k)
        return pa.table({"vec_id": pa.array(cat(0, np.int64), pa.int64()), "other": pa.array(cat(1, np.int64), pa.int64()), "cosine": pa.array(cat(2, np.float64), pa.float64())})

    return run


def nearest(index: Index, k: int = 10, margin: float = NEAR_MARGIN, block: int = BLOCK) -> DataFrame:
    """The ``k`` most similar other vectors of each vector: (vec_id, rank, other, cosine)."""
    shared = index.rows.sparkSession.sparkContext.broadcast(index.centroids)
    found = tasks(place(index, margin), block).groupBy("cell", "i", "j").applyInArrow(_nearest_fn(shared, index.dim, k), "vec_id bigint, other bigint, cosine double")
    # One list of k for each of its cells' blocks meets here per vector.
    lists = found.groupBy("vec_id").agg(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "other")).alias("s"))
    return lists.select("vec_id", F.posexplode(F.slice(F.array_sort("s"), 1, k)).alias("rank", "o")).select(
        "vec_id", (F.col("rank") + 1).alias("rank"), F.col("o.other").alias("other"), (-F.col("o.far")).alias("cosine")
    )


def named(index: Index, found: DataFrame, *columns: str) -> DataFrame:
    """Replace row numbers in ``columns`` by keys (the column keeps its name)."""
    for c in columns:
        keys = index.rows.select(F.col("vec_id").alias(c), F.col("vec_key").alias(f"{c}__key"))
        found = found.join(keys, c).drop(c).withColumnRenamed(f"{c}__key", c)
    return found
