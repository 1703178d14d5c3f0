"""Searches whose rows and queries grow together: by an index they give what brute force gives."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.operators import calibrate, knn, pivots, updates
from kinfold.operators.nearest import Nearest, first_copies
from kinfold.plans import pruned, queries
from kinfold.streaming import topk


@pytest.fixture
def points(spark):
    rng = random.Random(11)
    rows = [(i, [rng.randrange(30) / 3, rng.random()]) for i in range(600)] + [(600 + i, [1.0, 0.5]) for i in range(60)]
    rows += [(700, None), (701, [5.0, None])]
    return spark.createDataFrame(rows, "id long, obj array<double>").repartition(3).cache()


def asked(points):
    return points.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_equal_rows_are_held_k_times_a_query_at_most(monkeypatch):
    held = []
    best = Nearest._best
    monkeypatch.setattr(Nearest, "_best", lambda self: held.append(self.kept) or best(self))
    n, k = 1024, 2
    search = Nearest(pa.array(range(n)), np.zeros((n, 2)), np.full(n, np.inf), k, True)
    search.add(np.zeros((8192, 2)), pa.array(range(8191, -1, -1)))
    assert max(held, default=0) <= 2 * k * n + 4096 + 256 * (k + 1)
    found = pa.Table.from_batches(list(search.results())).to_pylist()
    assert sorted((r["qid"], r["id"]) for r in found if r["qid"] < 4) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert first_copies(np.array([[1.0], [2.0]]), pa.array([1, 2]), 1) is None


@pytest.mark.parametrize("exclude", [False, True])
def test_search_by_an_index_of_its_own(spark, points, monkeypatch, exclude):
    want = rows(knn.knn_exact(points, asked(points), 7, exclude_self=exclude))
    monkeypatch.setattr(pruned, "ALL_PAIRS", 0)
    monkeypatch.setattr(pruned, "CELL_ROWS", 20)
    monkeypatch.setattr(pruned, "knn_exact", None)
    assert rows(pruned.knn_searched(points, asked(points), 7, exclude_self=exclude)) == want
    _, assigned, cells = pivots.build_index(points.where("id < 400"), 20)
    assert rows(updates.knn_buffered(assigned, cells, points.where("id >= 400"), asked(points), 7, exclude_self=exclude)) == want
    chosen = pivots.pivots_fft(points, 4)  # null objects have no nearest pivot
    fit = calibrate.calibration(points, chosen, asked(points).where("qid < 700"), 7, exclude_self=exclude)
    assert rows(fit.select("qid", "kth_dist")) == sorted((r[0], r[3]) for r in want if r[1] == 7)


def test_an_audit_finds_what_pruning_loses_at_any_size(spark, monkeypatch):
    found, got = pruned._found, []
    monkeypatch.setattr(pruned, "_found", lambda *a: found(*a).where("id % 3 <> 1"))  # the search loses a third
    for most in (0, 1 << 28):
        monkeypatch.setattr(pruned, "ALL_PAIRS", most)
        got.append(rows(queries.recall_audit(spark, "/root/testdata/sf0.001")))
    assert got[0] == got[1]


def test_ablation_by_boxes(spark, points, monkeypatch):
    radii = knn.knn_exact(points, asked(points), 7, exclude_self=True).where("rank = 7").select("qid", F.col("dist").alias("radius"))
    radii = radii.union(spark.createDataFrame([(700, 1.0)], "qid long, radius double"))
    choices = {"fft": pivots.pivots_fft(points, 3), "hash": pivots.pivots_hash(points, 3)}
    want = rows(pivots.pivot_ablation(points.where("id < 700"), asked(points).where("qid < 700"), radii, choices))
    monkeypatch.setattr(pruned, "ALL_PAIRS", 0)
    plan = pivots.pivot_ablation(points.where("id < 700"), asked(points).where("qid < 700"), radii, choices)
    assert rows(plan) == want
    wide = radii.withColumn("radius", F.lit(3.0))
    got = rows(pivots.pivot_ablation(points.where("id < 700"), asked(points).where("qid < 700"), wide, choices))
    monkeypatch.setattr(pruned, "ALL_PAIRS", 1 << 28)
    assert got == rows(pivots.pivot_ablation(points.where("id < 700"), asked(points).where("qid < 700"), wide, choices))


def test_standing_queries_beyond_a_broadcast(spark, points, monkeypatch, tmp_path):
    want = rows(knn.knn_exact(points, asked(points), 7))
    monkeypatch.setattr(topk, "BROADCAST_QUERIES", 10)
    points.repartition(3, "id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert rows(topk.settled_topk(stream, asked(points), 7, f"{tmp_path}/lists", f"{tmp_path}/check")) == want


def test_placing_among_many_parts(spark, points, monkeypatch):
    chosen = pivots.pivots_fft(points, 2)
    assigned = pivots.assign_cells(points, chosen)
    _, cells = pivots.split_cells(assigned, pivots.rings(assigned, chosen), 20, most=8)
    want = rows(updates.place(points, cells, chosen).select("id", "cell", "pdist", F.col("pobj")[0]))
    monkeypatch.setattr(updates, "MOST_PARTS", 1)
    assert rows(updates.place(points, cells, chosen).select("id", "cell", "pdist", F.col("pobj")[0])) == want


@pytest.mark.parametrize("exclude", [False, True])
def test_fingerprints_by_products(spark, monkeypatch, exclude):
    rng = random.Random(5)
    data = [(i, [rng.getrandbits(64) - (1 << 63), rng.getrandbits(3)]) for i in range(150)] + [(200 + i, [0, 0]) for i in range(12)] + [(300, None)]
    data = spark.createDataFrame(data, "id long, obj array<long>").repartition(3)
    by_pairs = lambda a, b: knn.METRICS["tanimoto_bits"](a, b)
    want = rows(knn.knn_exact(data, asked(data), 7, by_pairs, exclude_self=exclude))
    assert rows(knn.knn_exact(data, asked(data), 7, "tanimoto_bits", exclude_self=exclude)) == want
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", 20)
    found = knn.knn_exact(data, asked(data), 7, "tanimoto_bits", exclude_self=exclude)
    assert rows(found) == want
    assert not any(x in found._jdf.queryExecution().toString() for x in ("CartesianProduct", "NestedLoop"))


def test_edit_search_by_an_index_beyond_all_pairs(spark, monkeypatch):
    from kinfold.operators import strings

    rng = random.Random(6)
    data = [(i, "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 14)))) for i in range(200)]
    data = spark.createDataFrame(data, "id long, obj string")
    want = rows(strings.knn_edit_searched(data, asked(data), 7, exclude_self=True))
    monkeypatch.setattr(strings, "ALL_PAIRS", 0)
    monkeypatch.setattr(strings, "knn_exact", None)
    assert rows(strings.knn_edit_searched(data, asked(data), 7, exclude_self=True)) == want


@pytest.mark.parametrize("need", [None, 1, 12])
def test_many_cells_are_met_by_groups(spark, monkeypatch, need):
    """What all cells tell, from far fewer pairs; pivots that tell nothing are always read."""
    rng = np.random.default_rng(4)
    n = 3000
    table = np.vstack([rng.random((n - 6, 2)), [[np.nan, 0], [np.inf, 1], [1e200, 0], [0.5, 0.5], [0.5, 0.5], [0.5, 0.5]]])
    lo, hi, cnt = rng.random(n) / 99, rng.random(n) / 30, rng.integers(1, 9, n)
    hi = np.maximum(lo, hi)
    hi[:3] = np.nan, np.inf, 0.4
    own = [(i, table[i].tolist(), float(lo[i]), float(hi[i]), int(cnt[i])) for i in range(n)]
    cells = spark.createDataFrame(own, "cell long, pobj array<double>, lo double, hi double, cnt long")
    seek = [(i, rng.random(2).tolist(), float(r)) for i, r in enumerate([0.0, 0.02, 0.3, np.inf, np.nan] * 20)] + [(200, [np.nan, 1.0], 1.0), (201, [9.0, 9.0], 1.0)]
    seek = spark.createDataFrame(seek, "qid long, qobj array<double>, radius double")
    monkeypatch.setattr(pruned, "GROUPED", n)
    found = lambda: sorted((r["qid"], r["cell"], round(r["radius"], 12) if r["radius"] == r["radius"] else None) for r in pruned._survey(cells, seek, need).collect())
    want = found()
    monkeypatch.setattr(pruned, "GROUPED", 512)
    assert found() == want and len(want) > 1000
    if need:
        pairs, span = [], pruned._span
        monkeypatch.setattr(pruned, "_span", lambda t, q: pairs.append(len(t) * len(q)) or span(t, q))
        plain = np.isfinite((table * table).sum(1)) & np.isfinite(hi) & (hi < 0.4)
        survey = pruned._Survey(table[plain], np.arange(n)[plain], lo[plain], hi[plain], cnt[plain], need)
        pairs.clear()
        survey.touched(rng.random((500, 2)), np.full(500, np.inf))
        assert sum(pairs) < 500 * n / 4


def test_parts_are_picked_as_by_the_fold(spark, points):
    chosen = pivots.pivots_fft(points, 2)
    assigned = pivots.assign_cells(points, chosen)
    large = pivots.rings(assigned, chosen).select("cell", "pobj", F.lit(9).alias("parts"))
    by_pairs = lambda a, b: knn.METRICS["l2"](a, b)
    got, want = (pivots._parts_sampled(assigned, large, metric, 200) for metric in ("l2", by_pairs))
    assert got.orderBy("cell").collect() == want.orderBy("cell").collect()
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def test_objects_of_one_file_are_assigned_by_all_tasks(spark, monkeypatch):
    few = spark.range(200).select("id", F.array(F.rand(1), F.rand(2)).alias("obj")).coalesce(1)
    met = []
    monkeypatch.setattr(pivots, "assign_cells", lambda df, *a, f=pivots.assign_cells: met.append(df.rdd.getNumPartitions()) or f(df, *a))
    monkeypatch.setattr(pivots, "SPREAD_PAIRS", 0, raising=False)
    pivots.build_index(few, 20)
    assert met == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
