"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size by hash.  Each shard gets a
directed graph: greedy searches from the medoid propose neighbours for every
vector, and relaxed distance pruning keeps those edges that no kept edge makes
superfluous.  A query runs a beam search on every shard; the nearest of all
shards are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.plans.staging import stage

DEGREE = 24
BEAM = 48
ALPHA = 1.2
TOGETHER = 256


def _distances(x: np.ndarray, norms: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q (rows, d) to the vectors at (rows, c); places of -1 are infinitely far."""
    dots = np.matmul(x[at], q[:, :, None])[:, :, 0]
    return np.where(at < 0, np.inf, norms[at] - 2 * dots + (q * q).sum(1)[:, None])


def beam_search(
    x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int = BEAM, wide: int = 4
) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the ``beam`` best found for each query, nearest first.

    Every round expands the ``wide`` nearest vectors of each beam that were not expanded yet.
    """
    norms = (x * x).sum(1)
    rows = np.arange(len(queries))[:, None]
    seen = np.zeros((len(queries), len(x) + 1), bool)  # the last column takes places of -1
    ids = np.full((len(queries), beam), -1)
    ids[:, 0] = entry
    seen[:, entry] = True
    far = _distances(x, norms, ids, queries)
    open_ = np.isfinite(far)
    live = np.arange(len(queries))
    while live.size:
        pick = np.argsort(~open_[live], 1, kind="stable")[:, :wide]
        use = np.take_along_axis(open_[live], pick, 1)
        at = np.where(use, np.take_along_axis(ids[live], pick, 1), -1)
        open_[live[:, None], pick] = False
        near = np.where(at[:, :, None] < 0, -1, graph[at]).reshape(len(live), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        seen[:, -1] = False
        dist = _distances(x, norms, near, queries[live])
        every = np.concatenate([far[live], dist], 1)
        keep = np.argsort(every, 1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), keep, 1)
        far[live] = np.take_along_axis(every, keep, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], near >= 0], 1), keep, 1)
        live = live[open_[live].any(1)]
    return ids, far


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours (points, degree) out of ``candidates`` (points, c), padded with -1.

    The nearest candidate is kept, and every other that is ``alpha`` times nearer
    to it than to the point goes; and so on with what is left.
    """
    norms = (x * x).sum(1)
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == points[:, None]] = -1
    dist = _distances(x, norms, candidates, x[points])
    order = np.argsort(dist, 1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    alive = candidates >= 0
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        if not alive.any():
            break
        best = alive.argmax(1)
        some = alive[rows, best]
        chosen = candidates[rows, best]
        out[some, k] = chosen[some]
        between = _distances(x, norms, candidates, x[chosen])
        alive &= alpha * alpha * between > dist
        alive[rows, best] = False
    return out


def build_graph(
    x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, passes: int = 1, seed: int = 3
) -> tuple[np.ndarray, int]:
    """(neighbours padded with -1, entry) of a shard's vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, 2 * degree), -1)
    first = min(degree, n - 1)
    if first:
        graph[:, :first] = (np.arange(n)[:, None] + rng.integers(1, n, (n, first))) % n
    for k in range(passes):
        relaxed = alpha if k == passes - 1 else 1.0
        order = rng.permutation(n)
        for lo in range(0, n, TOGETHER):
            points = order[lo : lo + TOGETHER]
            found, _ = beam_search(x, graph, entry, x[points], beam)
            graph[points, :degree] = robust_prune(x, points, np.concatenate([found, graph[points]], 1), degree, relaxed)
            graph[points, degree:] = -1
            # edges back, in order of their ends
            ends = graph[points, :degree]
            source = np.repeat(points, degree)[ends.ravel() >= 0]
            ends = ends.ravel()[ends.ravel() >= 0]
            order_back = np.argsort(ends, kind="stable")
            ends, source = ends[order_back], source[order_back]
            target, start, count = np.unique(ends, return_index=True, return_counts=True)
            slot = np.arange(len(ends)) - np.repeat(start, count)
            extra = np.full((len(target), count.max(initial=0)), -1)
            extra[np.repeat(np.arange(len(target)), count), slot] = source
            every = np.concatenate([graph[target], extra], 1)
            full = np.array([len(set(r[r >= 0].tolist())) > 2 * degree for r in every], bool)
            if full.any():
                graph[target[full], :degree] = robust_prune(x, target[full], every[full], degree, relaxed)
                graph[target[full], degree:] = -1
            rest = np.sort(every[~full], 1)[:, ::-1]
            rest[:, 1:][rest[:, 1:] == rest[:, :-1]] = -1
            rest[rest == target[~full, None]] = -1
            graph[target[~full]] = -np.sort(-rest, 1)[:, : 2 * degree]
    return graph, entry


def _classes(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """(__h1, __h2, __dim, __vec, __ids): one row per distinct vector, with its ``keep`` smallest ids.

    A nearest-neighbour list of ``keep`` can hold no more of a class, so nothing is lost.
    """
    vec = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    bad = F.exists("__vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.select(F.col(id_col).alias("__id"), vec.alias("__vec"))
        .where(F.col("__id").isNotNull() & F.col("__vec").isNotNull() & ~bad)
        .where(F.exists("__vec", lambda x: x != 0))
        .select(
            "__id", "__vec", F.size("__vec").alias("__dim"),
            F.xxhash64("__vec").alias("__h1"), F.xxhash64(F.lit("vector"), "__vec").alias("__h2"),
        ).distinct()
    )
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy("__h1", "__h2").orderBy("__id")))
    return (
        ranked.where(F.col("__rank") <= keep)  # ranked in every task before the shuffle
        .groupBy("__h1", "__h2", "__dim")
        .agg(F.min_by("__vec", "__rank").alias("__vec"), F.sort_array(F.collect_list("__id")).alias("__ids"))
    )


def nearest_neighbours(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 16_384,
    block: int = 1024,
    beam: int = 192,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row for which ``is_query`` holds.

    ``is_query`` is a predicate Column over ``vectors``.  Nearness is the Euclidean
    distance in double precision of the original vectors; ties go to the smaller
    id; a query's own id is left out.  Defined cases: null ids and vectors that
    are null, zero or hold null or non-finite numbers take no part; vectors only
    meet those of their own length; equal vectors are one node of the graph, and
    all their ids count; repeated rows count once; with fewer candidates than k all
    are returned; an empty table gives an empty table.

    Every row is indexed.  A shard holds about ``shard_rows`` distinct vectors and
    meets ``block`` queries at a time, so a task's memory is bounded, and a vector
    that a third of all rows share is one node.  A beam search reads a part of a shard
    that grows as its logarithm, so larger shards cost a query less in all; a task
    then builds for longer and the beam has to widen for the same recall.
    """
    classes = stage(_classes(vectors, id_col, vector_col, k + 1), "classes")
    asked = stage(
        vectors.where(is_query).select(
            F.col(id_col).alias("query_id"),
            F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("__vec"),
        ).select("query_id", F.xxhash64("__vec").alias("__q1"), F.xxhash64(F.lit("vector"), "__vec").alias("__q2"))
        .where(F.col("query_id").isNotNull()).distinct(),
        "asked",
    )
    queries = stage(
        classes.join(asked.select("__q1", "__q2").distinct(), (F.col("__h1") == F.col("__q1")) & (F.col("__h2") == F.col("__q2")), "left_semi")
        .select(F.col("__h1").alias("__q1"), F.col("__h2").alias("__q2"), "__dim", F.col("__vec").alias("__qvec")),
        "queries",
    )
    shards = max(1, -(-classes.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block))
    id_type = vectors.schema[id_col].dataType.simpleString()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__h1", "__h2"], ignore_index=True)  # the same graph in any order of arrival
        graph, entry = build_graph(np.stack(pdf["__vec"]))
        pdf["__node"] = np.arange(len(pdf))
        pdf["__entry"] = entry
        pdf["__near"] = [row[row >= 0].tolist() for row in graph]
        return pdf[["__shard", "__dim", "__node", "__entry", "__vec", "__ids", "__near"]]

    graphs = stage(
        classes.withColumn("__shard", F.pmod("__h1", F.lit(shards)).cast("int"))
        .groupBy("__shard", "__dim")
        .applyInPandas(
            build,
            f"__shard int, __dim int, __node int, __entry int, __vec array<double>, __ids array<{id_type}>, __near array<int>",
        ),
        "graphs",
    )

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame([], columns=["__q1", "__q2", "score", "__ids"], dtype=object)
        index = index.sort_values("__node", ignore_index=True)
        x, q = np.stack(index["__vec"]), np.stack(asked["__qvec"])
        graph = np.full((len(x), max(1, max(map(len, index["__near"])))), -1)
        for i, near in enumerate(index["__near"]):
            graph[i, : len(near)] = near
        found = np.concatenate(
            [
                beam_search(x, graph, int(index["__entry"][0]), q[i : i + TOGETHER], max(beam, k + 1))[0][:, : k + 1]
                for i in range(0, len(q), TOGETHER)
            ]
        )
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = np.sqrt(((x[node] - q[row]) ** 2).sum(1))
        return pd.DataFrame(
            {
                "__q1": asked["__q1"].to_numpy()[row], "__q2": asked["__q2"].to_numpy()[row],
                "score": score, "__ids": index["__ids"].to_numpy()[node],
            }
        )

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = graphs.withColumn("__block", each(blocks)).groupBy("__shard", "__dim", "__block")
    dealt = queries.withColumn("__block", F.pmod("__q2", F.lit(blocks)).cast("int")).withColumn("__shard", each(shards))
    found = index.cogroup(dealt.groupBy("__shard", "__dim", "__block")).applyInPandas(
        search, f"__q1 long, __q2 long, score double, __ids array<{id_type}>"
    )
    by_class = W.partitionBy("__q1", "__q2").orderBy("score", "__id")
    best = (
        found.select("__q1", "__q2", "score", F.explode("__ids").alias("__id"))
        .withColumn("__rank", F.row_number().over(by_class)).where(F.col("__rank") <= k + 1)
    )
    by_query = W.partitionBy("query_id").orderBy("score", "__id")
    return (
        asked.join(best, ["__q1", "__q2"])
        .where(F.col("__id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("__id").alias(id_col), "score")
    )
