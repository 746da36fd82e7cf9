"""Centroid clustering with a table of distances to fixed pivots (LAESA).

The distances of every vector to a few pivots are computed and stored once. In a round only the centroids' distances to the
pivots are new: the largest difference of two stored distances bounds a vector's distance to a centroid from below. A vector
takes the centroids in the order of their bounds and computes exact integer distances until the next bound exceeds the best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import only, stored

CLUSTERS, ROUNDS, UNIT, SIZE = 8, 10, 1024, 64
#: Below this sum of magnitudes squared distances of 64 components fit 64 bits; beyond it they are computed with Python's integers.
NARROW = 1 << 28
#: A component's limit: larger ones are no 64-bit integers after scaling.
LIMIT = float(1 << 62)
BATCH = 2048


def grid_vectors(rows: DataFrame, vector: str, key: str, size: int, unit: int) -> DataFrame:
    """(k, v): vectors of ``size`` finite components as integers floor(unit * x)."""
    slim = only(rows, *dict.fromkeys((key, vector))).select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("x"))

    def scaled(x: Column) -> Column:
        return x.cast("double") * F.lit(float(unit))

    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < LIMIT))
    return slim.where((F.size("x") == size) & fine).select("k", F.transform("x", lambda x: F.floor(scaled(x))).alias("v"))


def wide(*tables: np.ndarray) -> bool:
    """Whether squared distances between these may leave 64 bits."""
    return sum(max(int(t.max(initial=0)), -int(t.min(initial=0))) for t in tables) * np.sqrt(max(1.0, max(t.shape[-1] for t in tables) / SIZE)) >= NARROW


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row; Python integers where 64 bits may not hold them."""
    if wide(x, y):
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(axis=1)


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squares(vectors, p[None, :]).astype(np.float64) for p in pivots], axis=1)) if len(pivots) else np.zeros((len(vectors), 0))


def nearest(vectors: np.ndarray, stored_distances: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, exact squared distance, exact distances computed); ties go to the smaller number."""
    n, k = len(vectors), len(centroids)
    bound = np.zeros((n, k))
    to_pivots = pivot_distances(centroids, pivots)
    for p in range(len(pivots)):
        x, c = stored_distances[:, p, None], to_pivots[None, :, p]
        np.maximum(bound, np.abs(x - c) - 1e-12 * (x + c), out=bound)  # rounding never raises a bound
    order = np.argsort(bound, axis=1, kind="stable")
    exact = object if wide(vectors, centroids) else np.int64
    best, best_of, done = np.full(n, -1, exact), np.full(n, k, np.int64), 0
    rows = np.arange(n)
    for step in range(k):
        c = order[rows, step]
        if step:
            on = bound[rows, c] ** 2 <= best[rows].astype(np.float64) * (1 + 1e-12)  # the bounds only rise along the order
            rows, c = rows[on], c[on]
            if not len(rows):
                break
        d = squares(vectors[rows], centroids[c])
        done += len(rows)
        better = (best_of[rows] == k) | (d < best[rows]) | ((d == best[rows]) & (c < best_of[rows]))
        best[rows[better]], best_of[rows[better]] = d[better], c[better]
    return best_of, best, done


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), size)


def cluster(rows: DataFrame, seeds: int = CLUSTERS, rounds: int = ROUNDS, vector: str = "embedding", key: str = "vec_id", size: int = SIZE, unit: int = UNIT,
            seed_prefix: str = "3:") -> DataFrame:
    """Per kept vector: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another size, or hold a null or non-finite component, or one beyond 2**62 after scaling, have
    no row. Centroids start as the vectors whose key has the smallest SHA-256 with the prefix (null keys last; equal keys by
    their components); with fewer vectors there are fewer centroids. Repeated rows count each. Distances and sums beyond a
    long are null. An empty table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    grid = grid_vectors(rows, vector, key, size, unit)
    hashed = F.sha2(F.concat(F.lit(seed_prefix), F.col("k").cast("string")), 256)
    first = grid.orderBy(hashed.asc_nulls_last(), "v").limit(seeds).collect()  # as many rows as there are centroids
    pivots = np.array([r["v"] for r in first], np.int64).reshape(len(first), size)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                d = pivot_distances(_matrix(batch["v"], size), pivots)
                yield pa.RecordBatch.from_arrays([batch["k"], batch["v"], pa.array(list(d), pa.list_(pa.float64()))], names=["k", "v", "d"])

    table = stored(grid.mapInArrow(measure, f"k {kind}, v array<long>, d array<double>"))

    def visit(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                v = _matrix(batch["v"], size)
                yield (batch, v, *nearest(v, _matrix(batch["d"], len(pivots)), centroids, pivots)[:2])

    centroids = pivots
    for _ in range(rounds if len(pivots) else 0):
        moved = means(table, visit, centroids, size)
        if np.array_equal(moved, centroids):
            break  # later rounds would repeat this one
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, of, d in visit(batches, centroids):
            d = pa.array([x if x < 1 << 63 else None for x in d.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(of.astype(np.int32)), d], names=["k", "cluster", "distance"])

    final = stored(table.mapInArrow(assign, f"k {kind}, cluster int, distance long"))

    def inertia() -> Column:
        return F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).try_cast("long")

    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    inner = final.groupBy("cluster").agg(inertia().alias("cluster_inertia"))
    whole = final.agg(inertia().alias("inertia"))
    # one row per centroid
    of_cluster = F.broadcast(inner.join(facts, "cluster").withColumn("inertia", F.lit(whole.first()[0]).cast("long")))
    return final.join(of_cluster, "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def means(table: DataFrame, visit, centroids: np.ndarray, size: int) -> np.ndarray:
    """Componentwise floor(sum / count) of every centroid's vectors, exact; empty centroids stay. One row per centroid comes to the driver."""
    k, half = len(centroids), 1 << 32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, [[0] * size for _ in range(k)]
        for _, v, of, _ in visit(batches, centroids):
            if np.abs(v).max(initial=0) >= 1 << 50:
                v = v.astype(object)
            for c in np.unique(of).tolist():
                few = v[of == c]
                counts[c] += len(few)
                sums[c] = [a + b for a, b in zip(sums[c], few.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(counts, pa.int64()), pa.array([[s // half for s in r] for r in sums], pa.list_(pa.int64())),
             pa.array([[s % half for s in r] for r in sums], pa.list_(pa.int64()))], names=["c", "n", "high", "low"])

    def total(name: str, i: int) -> Column:
        return F.sum(F.element_at(name, i + 1).cast("decimal(38,0)"))

    parts = table.mapInArrow(add, "c int, n long, high array<long>, low array<long>")
    found = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[total("high", i) for i in range(size)]).alias("high"), F.array(*[total("low", i) for i in range(size)]).alias("low"))
    out = centroids.copy()
    for r in found.collect():
        if r["n"]:
            out[r["c"]] = [(int(h) * half + int(w)) // r["n"] for h, w in zip(r["high"], r["low"])]
    return out
