"""Graph search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import ann, queries


def brute(rows, queries, k):
    rows = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in rows:
            near = sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
            out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[20][1]) for i in range(400, 520)]  # a third share one vector
    rows += [(600, None), (620, [0.0] * 8), (640, [float("nan")] * 8), (660, [1.0, None] + [0.0] * 6), (680, [float("inf")] * 8), (700, [-0.0, 1.0])]
    return rows


def test_small_shards_are_exact(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = found(ann.nearest_neighbours(df.union(df.where("vec_id < 9")), F.col("vec_id") % 20 == 0, shard_rows=100, block=7))
    want = brute(rows, range(0, 720, 20), 10)
    assert {q for q, near in want.items() if near} == set(got)
    hits = 0
    for q, near in got.items():
        assert len(near) == len(want[q]) and near == sorted(near)
        hits += len({i for _, i in near} & {i for _, i in want[q]})
        assert all(abs(s - dict((i, d) for d, i in brute(rows, [q], 10**6)[q])[i]) < 1e-12 for s, i in near)
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = found(queries.op3_graph_ann(spark, sf))
    want = brute(data, [i for i, _ in data if i % 100 == 0], 10)
    assert set(got) == set(want)
    share = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert share >= 0.95


def test_recall_over_large_shards(spark):
    """20,000 clustered vectors in three shards, against brute force."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(200, 32))[rng.integers(0, 200, 20_000)] + 0.7 * rng.normal(size=(20_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = found(ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, shard_rows=8192))
    x = x.astype(float)
    hits = 0
    for q in range(0, 20_000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        near = got[q]
        assert len(near) == 10 and all(abs(s - d[i]) < 1e-12 for s, i in near)
        hits += len({i for _, i in near} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 2000


def test_null_ids_take_no_part(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 4.0]), (1, [1.0, 4.0])], "vec_id long, embedding array<double>")
    assert found(ann.nearest_neighbours(df, F.lit(True), k=3)) == {0: [(2.0, 1)], 1: [(2.0, 0)]}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert found(ann.nearest_neighbours(df, F.col("vec_id") == 0)) == {0: [(1.0, 1)]}
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pruning_keeps_diverse_edges():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 1], [-3, 0]])
    got = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1, 0]]), 3, 1.2)
    assert got.tolist() == [[1, 3, 4]]
