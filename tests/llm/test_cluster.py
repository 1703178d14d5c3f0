"""Clustering by bisectors against distances to all centroids."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import cluster

KINDS = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, width, scale=1024, seed=3):
    """Lloyd's rounds in whole numbers of any size."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(x * scale) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in order[:k]]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for _, x in kept]

    for _ in range(rounds):
        at = place()
        for j in range(len(c)):
            own = [x for (_, x), (_, b) in zip(kept, at) if b == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted([(i, j, d) for (i, _), (d, j) in zip(kept, place())], key=repr), c


def vectors(rng, n, width, kind):
    if kind == "grid":  # many ties
        return [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(width)]) for i in range(n)]
    if kind == "wide":
        return [(i, [rng.choice([1e9, -3e11, 0.5, -0.25]) for _ in range(width)]) for i in range(n)]
    if kind == "long":
        return [(i, [float(rng.randrange(-(2**20), 2**20)) for _ in range(width)]) for i in range(n)]
    return [(i, [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("kind,width,k,rounds", [("gauss", 8, 8, 10), ("grid", 2, 8, 4), ("grid", 3, 5, 0), ("long", 4, 6, 3), ("wide", 3, 4, 3), ("gauss", 1, 3, 5)])
def test_against_all_distances(spark, kind, width, k, rounds):
    import numpy as np

    rng = random.Random(f"{kind}{width}")
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors(rng, 200, width, kind)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (900, None), (901, []), (902, rows[0][1] + [1.0]), (903, [None] * width), (904, [float("nan")] * width), (905, [float("inf")] * width)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    got, centroids = cluster.cluster_vectors(df, k, rounds, width)
    want, own = brute(rows, k, rounds, width)
    assert centroids == own
    assert sorted([tuple(r) for r in got.collect()], key=repr) == [(i, j, d if d < 2**63 else None) for i, j, d in want]


def test_tournament_takes_few_tests():
    """The winner of k - 1 sign tests is the nearest, the smaller number among equals."""
    import numpy as np

    rng = np.random.default_rng(1)
    c = rng.integers(-3, 4, (7, 2)).tolist()
    c[5] = list(c[1])
    x = rng.integers(-4, 5, (500, 2)).astype(np.int64)
    normals, thresholds = cluster.bisectors(c, np.int64)
    best = cluster.tournament(x, normals, thresholds, 7)
    d = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(2)
    assert best.tolist() == d.argmin(1).tolist() and 5 not in best


def test_few_equal_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], KINDS)
    got, c = cluster.cluster_vectors(same, 8, 2, 2)
    assert {(r["cluster"], r["distance"]) for r in got.collect()} == {(0, 0)} and len(c) == 8
    got, c = cluster.cluster_vectors(same.limit(3), 8, 2, 2)
    assert got.count() == 3 and len(c) == 3
    got, c = cluster.cluster_vectors(same.limit(0), 8, 2, 2)
    assert got.count() == 0 and c == [] and got.columns == ["id", "cluster", "distance"]
    odd = same.withColumns({n: F.lit("x") for n in ("id", "x", "cluster", "distance", "n", "at")})
    assert cluster.cluster_vectors(odd, 2, 1, 2)[0].count() == 30


def test_too_many_centroids(spark, monkeypatch):
    monkeypatch.setattr(cluster, "MOST_NUMBERS", 10)
    with pytest.raises(ValueError, match="too many"):
        cluster.cluster_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0])], KINDS), 3, 1, 2)
