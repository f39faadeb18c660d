"""Centroid clustering of integer vectors by sort-means.

Each round sorts, for every centroid, the others by their distance from it. A vector is scanned from the centroid it
was assigned to last: candidates come in the order of their distance from that one, and the scan stops at the first
that lies strictly beyond twice the vector's own distance, because whatever follows is farther from the vector than
the centroid it has (at twice the distance exactly a candidate can still tie).

All sums are whole numbers: products go through floating point only where every partial sum is below 2^53, else
through 64-bit integers, so results do not depend on partitioning or on the order of summation.

State is a table of blocks, one row for some thousand vectors: their ids, components and assignments, and the block's
sums by centroid. A round reads the blocks and writes the next table; the update reads the sums alone and adds them up
in Spark. The driver sees K centroids and K sums, never vectors. No row is grouped by its centroid or its value, so
neither a centroid that most vectors share nor many equal vectors gather in a task.

Defined results: a vector counts if it has exactly ``size`` components, none null, NaN or infinite; others take no
part. Rows that share an id are vectors of their own; a null id counts as an empty text in the order of the starting
centroids. With fewer than K vectors there are as many centroids as vectors; an empty table gives an empty result.
Components beyond 2^25 after scaling are an error: four times their squared distances may not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, on_batches, stored

SCALE, LIMIT = 256, 1 << 25
_EXACT = float(1 << 53)
_STATE = "ids binary, unknown binary, vectors binary, cluster binary, distance binary, sums binary"
_OUT = "vec_id long, cluster int, distance long"


def usable(vector: Column, size: int) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, finite), F.lit(False))


def quantised(column: pa.Array, size: int) -> np.ndarray:
    """(n, size) int32: floor(256 x) of vectors that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component exceeds {LIMIT} after scaling")
    return x.astype(np.int32).reshape(-1, size)


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer arrays, as int64."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), np.int64)
    if float(np.abs(x).max()) * float(np.abs(c).max()) * x.shape[1] < _EXACT:
        return (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ c.T.astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x.astype(np.int64), x.astype(np.int64))


def scan(x: np.ndarray, centroids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smaller one of equals, and the squared distance."""
    own, size = norms(x), norms(centroids)
    apart = size[:, None] + size[None] - 2 * products(centroids, centroids)
    order = np.argsort(apart, axis=1, kind="stable")
    best, found = last.astype(np.int32).copy(), np.zeros(len(x), np.int64)
    for c in np.unique(last):
        at = np.flatnonzero(last == c)
        here = own[at] + size[c] - 2 * products(x[at], centroids[c : c + 1])[:, 0]
        far = np.argsort(-here, kind="stable")
        at, here = at[far], here[far]
        near, label = here.copy(), np.full(len(at), c, np.int32)
        # twice the distance, squared; rows with the largest come first, so those still scanning are a head
        reach = -4 * here
        for j in order[c]:
            if j == c:
                continue
            n = int(np.searchsorted(reach, -apart[c, j], side="right"))
            if n == 0:
                break
            d = own[at[:n]] + size[j] - 2 * products(x[at[:n]], centroids[j : j + 1])[:, 0]
            better = (d < near[:n]) | ((d == near[:n]) & (j < label[:n]))
            near[:n][better], label[:n][better] = d[better], j
        best[at], found[at] = label, near
    return best, found


def _row(ids: bytes, unknown: bytes, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int) -> pa.RecordBatch:
    """A block with its sums: for each centroid the count, the sum of distances, the sums of components."""
    sums = np.zeros((k, 2 + x.shape[1]), np.int64)
    by = np.argsort(cluster, kind="stable")
    some, at = np.unique(cluster[by], return_index=True)
    if len(some):
        sums[some, 0] = np.diff(np.append(at, len(by)))
        sums[some, 1] = np.add.reduceat(distance[by], at)
        sums[some, 2:] = np.add.reduceat(x[by].astype(np.int64), at, axis=0)
    columns = [ids, unknown, x.astype(np.int32).tobytes(), cluster.astype(np.int32).tobytes(), distance.tobytes(), sums.tobytes()]
    return pa.record_batch([pa.array([v], pa.binary()) for v in columns], names=[c.split()[0] for c in _STATE.split(", ")])


def _totals(blocks: DataFrame, k: int, width: int) -> list[list[int]]:
    """The blocks' sums added up, as K rows of whole numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * width, np.int64)
        for batch in batches:
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["place", "value"])

    got = blocks.select("sums").mapInArrow(each, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = [[0] * width for _ in range(k)]
    for r in got:  # k * width numbers at most
        out[r["place"] // width][r["place"] % width] = int(r["value"])
    return out


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, the centroids, and for each its count, its sum
    of distances and the sums of its components."""
    kept = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(usable(F.col("vector"), size))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.withColumn("h", digest).orderBy("h", "vector").limit(k).select("vector").toArrow()
    centroids = quantised(first.column("vector"), size).astype(np.int64)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], _OUT), centroids, []
    k = len(centroids)

    def begun(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = quantised(batch.column("vector"), size)
        ids = batch.column("vec_id")
        cluster, distance = scan(x, centroids, np.zeros(len(x), np.int32))
        yield _row(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), x, cluster, distance, k)

    blocks = stored(on_batches(kept, begun, _STATE), "sort-means-0")
    for step in range(1, rounds + 1):
        centroids = np.array([[v // row[0] for v in row[2:]] if row[0] else old.tolist() for row, old in zip(_totals(blocks, k, 2 + size), centroids, strict=True)], np.int64).reshape(k, size)

        def moved(batch: pa.RecordBatch, centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            for b in batch.to_pylist():
                x = np.frombuffer(b["vectors"], np.int32).reshape(-1, size)
                cluster, distance = scan(x, centroids, np.frombuffer(b["cluster"], np.int32))
                yield _row(b["ids"], b["unknown"], x, cluster, distance, k)

        blocks, before = stored(on_batches(blocks, moved, _STATE), f"sort-means-{step}"), blocks
        dropped(before)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in batch.to_pylist():
            ids = pa.array(np.frombuffer(b["ids"], np.int64), mask=np.frombuffer(b["unknown"], bool))
            yield pa.record_batch([ids, pa.array(np.frombuffer(b["cluster"], np.int32)), pa.array(np.frombuffer(b["distance"], np.int64))], names=["vec_id", "cluster", "distance"])

    return on_batches(blocks.select("ids", "unknown", "cluster", "distance"), rows, _OUT), centroids, _totals(blocks, k, 2 + size)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    rows, centroids, totals = clustered(embeddings, k, rounds, seed, size)
    inertia = [t[1] for t in totals]
    of = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)) if values else F.array().cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select("vec_id", "cluster", "distance", of(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of([digest(c) for c in centroids], "string").alias("centroid_sha256"))
