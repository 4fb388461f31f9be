"""Approximate search over vectors kept as a few bits per dimension.

Vectors are normalised, turned by random signs and a Walsh-Hadamard transform (which makes their coordinates nearly
normal), and each coordinate is kept as the index of the nearest level of a Lloyd-Max quantiser for the normal
distribution. A query stays in full precision; scores are inner products with the levels. The index is a table
(id, code), so adding, replacing, removing and saving are unions, anti-joins and writes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@lru_cache(8)
def levels(bits: int) -> np.ndarray:
    """Lloyd-Max levels of the standard normal distribution, by iteration on a fine grid."""
    x = np.linspace(-6, 6, 60_001)
    w = np.exp(-x * x / 2)
    out = np.interp((np.arange(2**bits) + 0.5) / 2**bits, np.cumsum(w) / w.sum(), x)
    for _ in range(200):
        cell = np.searchsorted((out[1:] + out[:-1]) / 2, x)
        mass = np.bincount(cell, w, 2**bits)
        out = np.where(mass > 0, np.bincount(cell, w * x, 2**bits) / np.maximum(mass, 1e-300), out)
    return out.astype(np.float32)


def padded(dim: int) -> int:
    return 1 << (dim - 1).bit_length()


def rotate(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Random signs and a Walsh-Hadamard transform of the rows, padded to a power of two; keeps lengths."""
    n = padded(x.shape[1])
    y = np.zeros((len(x), n), np.float32)
    y[:, : x.shape[1]] = x
    y *= np.where(np.random.default_rng(seed).random(n) < 0.5, -1, 1).astype(np.float32)
    h = 1
    while h < n:
        z = y.reshape(len(y), n // (2 * h), 2, h)
        y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), 2).reshape(len(y), n)
        h *= 2
    return y / np.sqrt(n)


def _pack(codes: np.ndarray, bits: int) -> np.ndarray:
    planes = ((codes[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8)
    return np.packbits(planes.reshape(len(codes), -1), axis=1, bitorder="little")


def _unpack(raw: np.ndarray, bits: int, n: int) -> np.ndarray:
    planes = np.unpackbits(raw, axis=1, bitorder="little")[:, : n * bits].reshape(len(raw), n, bits)
    return (planes.astype(np.uint16) << np.arange(bits, dtype=np.uint16)).sum(2)


def encode(vectors: DataFrame, id: str, vector: str, dim: int, bits: int = 3) -> DataFrame:
    """(id, code): ceil(padded dim * bits / 8) bytes per vector. Null, shorter and all-zero vectors are left out."""
    if not 1 <= bits <= 8:
        raise ValueError("bits are 1 to 8")
    kind = vectors.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = levels(bits)
        edges = (lv[1:] + lv[:-1]) / 2
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            y = rotate(x[ok] / norm[ok, None]) * np.sqrt(padded(dim))
            raw = _pack(np.searchsorted(edges, y).astype(np.uint8), bits)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in raw], pa.binary())], ["id", "code"])

    return vectors.where(F.size(vector) == dim).select(F.col(id).alias("id"), F.col(vector).alias("v")).mapInArrow(run, f"id {kind}, code binary")


def search(index: DataFrame, query: Sequence[float], n: int, bits: int = 3) -> DataFrame:
    """The ``n`` best (id, score) by estimated cosine; a top-k per partition and a merge."""
    q = np.asarray(query, np.float32)[None, :]
    q = q / max(float(np.linalg.norm(q)), 1e-12)
    turned, size = rotate(q)[0], padded(q.shape[1])
    kind = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = levels(bits) / np.sqrt(size)
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            score = lv[_unpack(raw, bits, size)] @ turned
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score.astype(np.float64))], ["id", "score"])

    return index.mapInArrow(run, f"id {kind}, score double").orderBy(F.desc("score"), "id").limit(n)


def add(index: DataFrame, more: DataFrame) -> DataFrame:
    """The index with new or replaced rows."""
    return index.join(more.select("id"), "id", "left_anti").unionByName(more)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.length("code")).alias("bytes"))


def lsh_model(vectors: DataFrame, vector: str, bucket: float = 1.0, tables: int = 6):
    """Bucketed random projections of the machine-learning library, as another approximate index."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    df = vectors.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=5).fit(df)
    return model, df
