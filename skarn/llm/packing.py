"""Filling containers of fixed capacity with documents that lie near each other on a space-filling curve.

Each document's tokens are hashed to a signed vector, projected to a few dimensions and placed on a Hilbert curve. The
rows are range-sorted by their place on the curve, and each range is walked along the curve: the documents of a window
that is some containers wide are packed by best fit, containers that are full are closed, and the documents of the others
go on into the next window. So a container holds neighbours, and little room is lost. What is left at the end of a range
is packed with what is left of the ranges next to it. Documents larger than a container are split into full ones and a
rest; nothing else is split.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skarn.llm import tokens
from skarn.session import cut, parallelism

DIMS, BITS = 4, 10
#: Width of a window in containers, share of a container that may stay empty when it is closed, and documents, about,
#: that go on into the next window at most; beyond that the fullest containers are closed.
WINDOW, SPARE, POOL = 16, 0.005, 256
#: Tokens of a range at most, about: its keys are held while it is walked.
RANGE_TOKENS = 1 << 28
#: Ranges whose ends are packed together.
JOINED = 64
#: A range shall hold at least this many tokens, in units of the largest capacity.
RANGE_CONTAINERS = 64


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows x dims, each below 2**bits), after Skilling's transform."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def token_directions(vocab: int, dims: int = DIMS) -> np.ndarray:
    """A fixed pseudo-random direction for each token id: hashing and projection in one table."""
    return np.random.default_rng(17).standard_normal((vocab, dims)).astype(np.float32)


def measured(df: DataFrame, key: str, text: str, path: str = tokens.DEFAULT) -> DataFrame:
    """(key, size, curve): tokens of each text and its place on the curve; null and empty texts are left out."""
    shared = tokens.shipped(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder_of(shared.value)
        directions = token_directions(max(enc.automaton.label) + 1)
        for b in batches:
            for i, j, ids, sizes in enc.batches(b.column(1).to_pylist()):
                doc = np.repeat(np.arange(j - i), sizes)
                # Each distinct token of a document counts with the root of its number of occurrences.
                pair, n = np.unique(doc.astype(np.int64) * len(directions) + ids, return_counts=True)
                place = np.zeros((j - i, DIMS))
                owner, w = pair // len(directions), directions[pair % len(directions)] * np.sqrt(n)[:, None]
                for dim in range(DIMS):
                    place[:, dim] = np.bincount(owner, weights=w[:, dim], minlength=j - i)
                place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)
                grid = np.clip(((place + 1) / 2 * (2**BITS)).astype(np.int64), 0, 2**BITS - 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(hilbert_keys(grid))], ["key", "size", "curve"])

    rows = df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, size bigint, curve bigint")


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Containers (free, items) of (size, number) items, the largest first, each into the fullest that has room."""
    room: list[tuple[int, int]] = []  # (free, container), ascending
    held: list[list[tuple[int, int]]] = []
    for item in sorted(items, key=lambda i: (-i[0], i[1])):
        at = bisect_left(room, (item[0], -1))
        if at < len(room):
            free, c = room.pop(at)
        else:
            free, c = capacity, len(held)
            held.append([])
        held[c].append(item)
        insort(room, (free - item[0], c))
    return [(free, held[c]) for free, c in room]


class Packer:
    """Packs (size, number) items, sizes at most the capacity, in windows of the order in which they come."""

    def __init__(self, capacity: int):
        self.capacity, self.pool, self.gathered = capacity, [], 0

    def add(self, size: int, number: int) -> list[list[tuple[int, int]]]:
        """Takes an item; the containers that are closed by it."""
        self.pool.append((size, number))
        self.gathered += size
        return self.close() if self.gathered >= WINDOW * self.capacity else []

    def close(self) -> list[list[tuple[int, int]]]:
        out, left, n, self.gathered = [], [], len(self.pool), 0
        for free, items in best_fit(self.pool, self.capacity):
            if free <= SPARE * self.capacity or n > POOL:
                out.append(items)
                n -= len(items)
            else:
                left += items
        self.pool = sorted(left, key=lambda i: i[1])
        return out


def pack(df: DataFrame, key: str, text: str, capacities: list[tuple[str, int]], path: str = tokens.DEFAULT) -> DataFrame:
    """(pack_name, key, piece, container, size): every piece of every document in a container of each capacity.

    Defined cases: null and empty texts have nothing to place; equal documents are placed each; a capacity below one is
    an error; an empty table gives an empty result. Container numbers are unique within a pack_name. A key that occurs
    twice is placed twice (with equal piece numbers).
    """
    if any(c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive")
    kind = df.schema[key].dataType.simpleString()
    sized = cut(measured(df, key, text, path), "sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    largest = max([c for _, c in capacities], default=1)
    ranges = int(max(1, min(total // (RANGE_CONTAINERS * largest), 4 * parallelism(df.sparkSession)), total // RANGE_TOKENS))
    ordered = sized.repartitionByRange(ranges, "curve", "key").sortWithinPartitions("curve", "key")
    columns = ("pack_name", "key", "piece", "container", "size", "joined", "place")

    def batch(name: str, keys: list, rows: list[tuple[int, int, int | None, int]], joined: int) -> pa.RecordBatch:
        """Rows (number of the key, piece, container or none, size)."""
        at, piece, container, size = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(rows), pa.string()), pa.array([keys[i] for i in at], key_type), pa.array(piece, pa.int32()), pa.array(container, pa.int64()), pa.array(size, pa.int64()),
                pa.array([joined] * len(rows), pa.int32()), pa.array(at, pa.int64()),
            ],
            columns,
        )

    key_type = to_arrow_type(df.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        following = own << 40  # number of the next container, one count for all packs
        packers = [(name, cap, Packer(cap)) for name, cap in capacities]
        keys: list = []  # of the whole range: a few MB for the rows of one task
        pieces: list[dict[int, int]] = [{} for _ in capacities]  # pieces before the rest of a document that was split
        for b in batches:
            first = len(keys)
            keys += b.column(0).to_pylist()
            sizes = b.column(1).to_pylist()
            for p, (name, cap, packer) in enumerate(packers):
                rows: list[tuple[int, int, int | None, int]] = []
                for number, size in enumerate(sizes, first):
                    whole, rest = divmod(size, cap)
                    for piece in range(whole):
                        rows.append((number, piece, following, cap))
                        following += 1
                    if not rest:
                        continue
                    if whole:
                        pieces[p][number] = whole
                    for items in packer.add(rest, number):
                        rows += [(n, pieces[p].get(n, 0), following, s) for s, n in items]
                        following += 1
                if rows:
                    yield batch(name, keys, rows, own // JOINED)
        for p, (name, _, packer) in enumerate(packers):
            if packer.pool:
                yield batch(name, keys, [(n, pieces[p].get(n, 0), None, s) for s, n in packer.pool], own // JOINED)

    schema = f"pack_name string, key {kind}, piece int, container bigint, size bigint, joined int, place bigint"
    packed = cut(ordered.select("key", "size").mapInArrow(run, schema), "packed")
    sizes_of = dict(capacities)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, items, following, was = None, [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal following
            rows = []
            for _, held in best_fit([(s, i) for i, (_, s) in enumerate(items)], sizes_of[group[1]]):
                rows += [(i, items[i][0], following, s) for s, i in held]
                following += 1
            yield batch(group[1], keys, rows, group[0])

        for b in batches:
            for joined, name, key_, piece, size in zip(*(b.column(i).to_pylist() for i in (5, 0, 1, 2, 4))):
                if (joined, name) != group:
                    if items:
                        yield from flush()
                    if joined != was:  # the joined ranges count their containers behind those of all ranges
                        following, was = (ranges + joined) << 40, joined
                    group, keys, items = (joined, name), [], []
                keys.append(key_)
                items.append((piece, size))
        if items:
            yield from flush()

    tail = packed.where("container is null").repartition(math.ceil(ranges / JOINED), "joined").sortWithinPartitions("joined", "pack_name", "place", "key").mapInArrow(ends, schema)
    return packed.where("container is not null").unionByName(tail).drop("joined", "place").withColumnRenamed("key", key)
