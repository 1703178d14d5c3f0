"""Centroid clustering of integer vectors by a bisector tournament.

A vector is nearer to centroid j than to centroid i if it lies beyond the plane
half-way between them: n . x > t with n = 2 (c_j - c_i) and t = |c_j|^2 - |c_i|^2.
Normals and thresholds of all pairs are computed once a round; a vector then plays
k - 1 such sign tests, each of which eliminates one centroid, and the sign zero
favours the smaller number.  Only the winner's distance is computed.  All numbers
are integers, so every test and every mean is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.plans.staging import stage

#: Most numbers in the normals of all pairs of centroids (64 MiB): they go to every task.
MOST_NUMBERS = 8 << 20
#: Vectors that play at once.
TOGETHER = 4096


def _kind(centroids: list[list[int]], most: int):
    """The number type in which sign tests and distances over components of up to ``most`` are exact."""
    reach = max([most, *(abs(v) for c in centroids for v in c)], default=0)
    bound = 8 * max(1, len(centroids[0])) * (reach + 1) ** 2
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def bisectors(centroids: list[list[int]], kind) -> tuple[np.ndarray, np.ndarray]:
    """(normals, thresholds) for i < j, at i * k + j."""
    c = np.array(centroids, dtype=object)
    k = len(c)
    normals, thresholds = np.zeros((k * k, c.shape[1]), dtype=kind), np.zeros(k * k, dtype=kind)
    squares = [sum(int(v) * int(v) for v in row) for row in c]
    for i in range(k):
        for j in range(i + 1, k):
            normals[i * k + j] = (2 * (c[j] - c[i])).astype(kind)
            thresholds[i * k + j] = squares[j] - squares[i]
    return normals, thresholds


def tournament(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray, k: int) -> np.ndarray:
    """The nearest centroid of every row of ``x``, ties to the smaller number, by k - 1 sign tests."""
    best = np.zeros(len(x), np.int64)
    for j in range(1, k):
        at = best * k + j
        # those with the same champion share a plane
        for i in np.unique(best):
            own = np.flatnonzero(best == i)
            beyond = (x[own] * normals[i * k + j]).sum(1) if x.dtype == object else x[own] @ normals[i * k + j]
            best[own[beyond > thresholds[at[own]]]] = j
    return best


def _rows(column: pa.Array, width: int, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.array(flat.tolist(), dtype=object) if kind is object else flat.astype(kind)).reshape(-1, width)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(id, x) of the vectors of ``width`` finite components, each floor(scale * component) as a whole number.

    Vectors that are null, of another width or hold null, NaN or infinity are left
    out, and so are those with a component of 2^52 or more after scaling, which a
    double doesn't hold exactly.
    """
    v = F.col(vector_col)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(1 << 52))
    kept = df.where((F.size(v) == width) & F.forall(v, fine))
    return kept.select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of 'seed:id', in that order; equal ids go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in vectors.select("x", order.alias("h")).orderBy("h", "x").limit(k).collect()]


def _places(vectors: DataFrame, centroids: list[list[int]], most: int, sums: bool) -> DataFrame:
    """(id, cluster, distance) of every vector, or with ``sums`` (cluster, x, n): each task's sums by cluster."""
    kind = _kind(centroids, most)
    k, width = len(centroids), len(centroids[0])
    shared = vectors.sparkSession.sparkContext.broadcast((*bisectors(centroids, kind), np.array(centroids, dtype=object).astype(kind)))

    def batches_of(batches: Iterator[pa.RecordBatch]):
        normals, thresholds, table = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                x = _rows(part.column("x"), width, kind)
                yield part, x, tournament(x, normals, thresholds, k), table

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, best, table in batches_of(batches):
            gap = x - table[best]
            total = (gap * gap).sum(1)
            fits = [int(v) if v < 2**63 else None for v in total] if kind is object else total.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(best, pa.int32()), pa.array(fits, pa.int64())], names=["id", "cluster", "distance"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [[0] * width for _ in range(k)], [0] * k
        for _, x, best, _ in batches_of(batches):
            for c in np.unique(best):
                own = x[best == c]
                count[c] += len(own)
                part = own.sum(0) if kind is object else own.astype(np.int64).sum(0)
                total[c] = [t + int(v) for t, v in zip(total[c], part)]
        held = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array([[str(v) for v in total[c]] for c in held], pa.list_(pa.string())),
             pa.array([count[c] for c in held], pa.int64())],
            names=["cluster", "x", "n"],
        )

    if sums:
        return vectors.select("x").mapInArrow(add, "cluster int, x array<string>, n long")
    return vectors.select("id", "x").mapInArrow(label, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster_vectors(
    df: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every kept vector, the final centroids).

    See integer_vectors() for what is kept and first_centroids() for the start.  Each
    round assigns every vector and replaces each centroid that has any by the exact
    floor of their mean; one without vectors stays.  Distances are squared, null where
    they pass 2^63.  With fewer than ``k`` vectors there are as many centroids; an empty
    table gives no rows.  Rows that repeat and null ids are vectors like any other; equal
    centroids are allowed, the smaller number then takes all.  Extra columns stay out.

    A round moves k sums a task: tasks add up by cluster, so a cluster of a third of
    all vectors is as cheap as any.  The driver holds k centroids.
    """
    vectors = stage(integer_vectors(df, id_col, vector_col, width, scale), "integers")
    now = first_centroids(vectors, k, seed)
    if not now:
        return vectors.select(F.col("id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    if len(now) ** 2 * width > MOST_NUMBERS:
        raise ValueError("too many centroids to send all their bisectors to every task")
    # centroids are means of vectors, so no component is ever larger
    most = int(vectors.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0])
    for _ in range(rounds):
        each = _places(vectors, now, most, sums=True).select("cluster", "n", F.posexplode("x").alias("at", "v"))
        rows = (
            each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
            .collect()  # k * width sums
        )
        moved = [list(c) for c in now]
        for r in rows:
            moved[r["cluster"]][r["at"]] = int(r["v"]) // r["n"]
        now = moved
    return _places(vectors, now, most, sums=False), now
