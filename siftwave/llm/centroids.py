"""Centroid clustering of integer vectors, exact, by partial-distance search.

Squared differences are added up dimension by dimension, those of high variance first. A vector
first measures the centroid that looks nearest after the first dimensions; every other centroid is
abandoned once its partial sum is strictly above the best whole distance, and the survivors finish
all dimensions. Partial sums never fall, so the result is that of a full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.storage import stored

STRIDE = 8  # dimensions between two looks at who is left
BLOCK = 4096  # vectors that a task measures at once
LARGEST = 2**27  # components up to here have squared distances in a long, over 64 dimensions


def integer_vectors(rows: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v (array<int>), floor(scale * x) of rows (vec_id, embedding) with exactly `dims` finite components.

    Rows with a null vector, another length, or a null or non-finite component are left out. A
    component beyond LARGEST is an error, since exact distances would leave 64 bits.
    """
    x = F.col("embedding").cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    held = rows.where((F.size("embedding") == dims) & F.forall(x, finite))
    fits = lambda e: F.when(F.abs(e) <= LARGEST / scale, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return held.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, fits).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `<seed>:<vec_id>`; of equal ids the smaller vector first, a null id as an empty text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [r["v"] for r in vectors.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()]


def assign(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many squared differences that took."""
    x, centroids = x[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    (n, dims), k = x.shape, len(centroids)
    sums = np.zeros((n, k), np.int64)
    for d in range(min(stride, dims)):
        sums += (x[:, d, None] - centroids[None, :, d]) ** 2
    terms = sums.size * min(stride, dims)
    best = sums.argmin(1)
    rest = slice(stride, dims)
    bound = sums[np.arange(n), best] + ((x[:, rest] - centroids[best, rest]) ** 2).sum(1)
    terms += n * max(0, dims - stride)
    row, c = np.nonzero(sums <= bound[:, None])
    part = sums[row, c]
    for at in range(stride, dims, stride):
        alive = part <= bound[row]
        row, c, part = row[alive], c[alive], part[alive]
        some = slice(at, at + stride)
        part = part + ((x[row, some] - centroids[c, some]) ** 2).sum(1)
        terms += len(row) * min(stride, dims - at)
    # Survivors have whole distances; the first of the nearest wins.
    low = bound.copy()
    np.minimum.at(low, row, part)
    found = np.full(n, k)
    nearest = part == low[row]
    np.minimum.at(found, row[nearest], c[nearest])
    return found, low, terms


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _spread(vectors: DataFrame, dims: int) -> list[int]:
    """Positions by falling variance; whole tables of sums are as many rows as tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dims, np.int64), np.zeros(dims)
        for b in batches:
            x = _matrix(b.column("v"), dims)
            n, sums, squares = n + len(x), sums + x.sum(0, dtype=np.int64), squares + (x.astype(float) ** 2).sum(0)
        yield pa.record_batch({"n": pa.array([n]), "s": pa.array([sums.astype(float)]), "q": pa.array([squares])})

    parts = vectors.select("v").mapInArrow(run, "n long, s array<double>, q array<double>")
    r = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[d]).alias(f"{c}{d}") for c in "sq" for d in range(dims)]).first()
    variance = [r[f"q{d}"] / r["n"] - (r[f"s{d}"] / r["n"]) ** 2 for d in range(dims)]
    return sorted(range(dims), key=lambda d: (-variance[d], d))


def _moved(vectors: DataFrame, centroids: list[list[int]], order: list[int]) -> list[list[int]]:
    """Centroids after one round: each task sums the vectors of its clusters, Spark adds the sums up."""
    dims, held = len(order), vectors.sparkSession.sparkContext.broadcast(np.array(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(held.value), np.int64), np.zeros((len(held.value), dims), np.int64)
        for b in batches:
            x = _matrix(b.column("v"), dims)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK].astype(np.int64)
                cluster, _, _ = assign(part, held.value, np.array(order))
                by = np.argsort(cluster, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(cluster[by]) > 0))
                n += np.bincount(cluster, minlength=len(n))
                sums[cluster[by][starts]] += np.add.reduceat(part[by], starts)
        some = np.flatnonzero(n)
        yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]), "s": pa.array(list(sums[some]), pa.list_(pa.int64()))})

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, s array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims)]).collect()
    out = list(centroids)
    for r in rows:
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    held.destroy()
    return out


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for each of vectors (vec_id, v), a stored table, and the final centroids.

    Fewer than k vectors give fewer centroids, none an empty table. Empty clusters keep their
    centroid. Equal vectors may be several centroids; the smaller number gets all of them. Only sums
    of clusters and k centroids pass the driver. Repeated rows and ids count as often as they stand.
    """
    spark, centroids = vectors.sparkSession, first_centroids(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], schema), centroids
    dims = len(centroids[0])
    order = _spread(vectors, dims)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, order)
    held = spark.sparkContext.broadcast(np.array(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.slice(at, BLOCK)
                cluster, distance, _ = assign(_matrix(part.column("v"), dims), held.value, np.array(order))
                yield pa.record_batch({"vec_id": part.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)})

    return vectors.mapInArrow(run, schema), centroids


def cluster_rows(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """The digest columns of op12; columns of embeddings other than vec_id and embedding are not read."""
    vectors = stored(integer_vectors(embeddings.select("vec_id", "embedding")), "vectors")
    found, centroids = cluster_vectors(vectors, k, rounds, seed)
    found = stored(found, "clusters")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = {r["cluster"]: r["cluster_inertia"] for r in own.collect()}  # k rows at most
    about = [(i, total.get(i, 0), sum(total.values()), digest) for i, digest in digests]
    table = found.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
