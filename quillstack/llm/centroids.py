"""Centroid clustering of whole-number vectors, exact to the last bit.

Which centroid is nearest is screened in float32: one fast matrix product gives every
centroid's squared distance but for the vector's own norm, and the error that float32 sums can make at most,
whatever their order, makes it an interval. If only one interval reaches below all
others' upper ends, its centroid is nearest for certain; the others, where several do, are computed
again in whole numbers, and a tie goes to the smaller number.

A round is one pass over packed blocks of vectors. Each gives sums for each
centroid, so what meets is centroids times blocks; the driver holds the centroids,
whose number is a parameter, and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import arrow_schema
from .common import cut, numbered
from .vectors import blocks_of, finite, matrix, pack, whole

#: Vectors in a block: at least, at most; and blocks until they grow.
BLOCK = (4096, 1 << 14, 4096)
#: Vectors that are screened at a time.
STEP = 8192
#: Unit roundoff of float32.
ROUNDOFF = 2.0**-24


@dataclass(frozen=True)
class Clustering:
    """centroids: ascending numbers; assigned: the id, cluster, distance of each vector; inertia: of each cluster."""

    centroids: np.ndarray
    assigned: DataFrame
    inertia: tuple[int, ...]


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |c|^2 - 2 x.c for all pairs, from a product in float32.

    The product's error is at most g |x| |c|, g = m u / (1 - m u) with u float32's
    roundoff and m the number of components and 2 more for turning each side to float32; this
    holds for any order of summation. The double-precision steps after it add less than 1e-9 of what they
    sum, which the last factor covers.
    """
    m = (x.shape[1] + 2) * ROUNDOFF
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    own = np.einsum("ij,ij->i", c, c).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))[:, None] * np.sqrt(own)
    middle = own - 2 * product
    error = 2 * m / (1 - m) * norms * (1 + 1e-6) + 1e-9 * (own + 2 * norms)
    return middle - error, middle + error


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance to it, vectors that exact numbers decided)."""
    cluster, settled = np.empty(len(x), np.int64), 0
    for at in range(0, len(x), STEP):
        some = x[at : at + STEP]
        low, high = intervals(some, c)
        may = low <= high.min(axis=1, keepdims=True)
        own = may.argmax(axis=1)
        open_ = np.flatnonzero(np.count_nonzero(may, axis=1) > 1)
        if len(open_):
            row, number = np.nonzero(may[open_])
            gap = some[open_][row] - c[number]
            exact = np.full((len(open_), len(c)), np.iinfo(np.int64).max)
            exact[row, number] = np.einsum("ij,ij->i", gap, gap)
            own[open_] = exact.argmin(axis=1)  # the first of equal ones
        cluster[at : at + STEP] = own
        settled += len(open_)
    gap = x - c[cluster] if len(x) else x
    return cluster, np.einsum("ij,ij->i", gap, gap), settled


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, dim).astype(np.int64)


def _sums(blocks: DataFrame, c: np.ndarray, dim: int) -> tuple[np.ndarray, list[int], list[list[int]]]:
    """(how many vectors each centroid has, the sum of their distances, their componentwise sums)."""
    kind = "cluster int, n long, distance long, total array<long>"
    arrow = arrow_schema(blocks, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = unpacked(data, dim)
                own, distance, _ = nearest(x, c)
                used = np.unique(own)
                members = [own == k for k in used]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int32)), pa.array([int(m.sum()) for m in members], pa.int64()), pa.array([int(distance[m].sum()) for m in members], pa.int64()),
                    pa.array([x[m].sum(axis=0).tolist() for m in members], arrow.field(3).type),
                ], schema=arrow)

    parts = blocks.select("vectors").mapInArrow(run, kind)
    found = parts.groupBy("cluster").agg(F.sum("n"), F.sum("distance"), *(F.sum(F.get("total", F.lit(k))) for k in range(dim))).collect()
    n, distance, total = np.zeros(len(c), np.int64), [0] * len(c), [[0] * dim for _ in c]
    for r in found:  # a row for each centroid
        n[r[0]], distance[r[0]], total[r[0]] = r[1], r[2], list(r)[3:]
    return n, distance, total


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Clusters the vectors of `dim` components, none null or non-finite; others take no part and have no row.

    Components become floor(scale * x). Centroids start as the k vectors with the
    smallest SHA-256 of "<seed>:<id>" (in hexadecimal), in that order; all vectors, if there are fewer. A round assigns each
    vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves each centroid
    that has vectors to floor(sum / count) of their components. Vectors are assigned
    once more at the end. Rows that share an id are separate vectors, which start in the order of their components; a null id is hashed
    as an empty text. Components of 2^27 / scale and more raise OverflowError. Other columns are not read.
    """
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(finite("vector") & (F.size("vector") == dim))
    used, row = numbered(plain, "id", "vector")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = used.orderBy(key, row).limit(k).select("vector").collect()
    used = used.withColumn("row", F.col(row).cast("long"))
    assigned = used.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    if not first:
        return Clustering(np.zeros((0, dim), np.int64), assigned.where("false"), ())
    c = whole(np.array([r[0] for r in first], np.float64), scale)
    blocks = cut(pack(used.select("row", "vector"), blocks_of(used.count(), *BLOCK), lambda t, d: {"rows": [t["row"].to_numpy().tobytes()], "vectors": [whole(matrix(t["vector"], d), scale).astype(np.int32).tobytes()]}, "rows binary, vectors binary"))
    for _ in range(rounds):
        n, _, total = _sums(blocks, c, dim)
        c = np.array([[s // int(m) for s in t] if m else own.tolist() for m, t, own in zip(n, total, c, strict=True)], np.int64)
    _, inertia, _ = _sums(blocks, c, dim)
    kind = "row long, cluster int, distance long"
    arrow = arrow_schema(blocks, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                own, distance, _ = nearest(unpacked(data, dim), c)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rows, np.int64)), pa.array(own.astype(np.int32)), pa.array(distance)], schema=arrow)

    assigned = blocks.select("rows", "vectors").mapInArrow(run, kind)
    assigned = assigned.withColumnRenamed("row", "id") if row == "id" else assigned.join(used.select("row", "id"), "row").drop("row")
    return Clustering(c, assigned.withColumnRenamed("id", id_col), tuple(inertia))


def with_inertia(found: Clustering) -> DataFrame:
    """assigned with cluster_inertia, inertia (of all) and centroid_sha256 (its components, joined by commas)."""
    if not found.inertia:
        return found.assigned.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    each = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return found.assigned.withColumns({"cluster_inertia": each(found.inertia).cast("long"), "inertia": F.lit(sum(found.inertia)).cast("long"), "centroid_sha256": each(digests)})
