"""Tiled search, the tree of cells and the survey of them against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import ODD, ask, by_pairs, exact_rows, frame, objects, vectors

from kinfold.operators import knn, pivots
from kinfold.plans import pruned
from kinfold.plans.staging import stage


@pytest.fixture
def odd_data(spark):
    rows = [*vectors(3, 90, ODD), (500, None), (501, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0])]
    return spark.createDataFrame(rows, "id long, obj array<double>").repartition(3)


@pytest.mark.parametrize("k,exclude,held,seeds,rows", [(2, True, 4, 5, 3), (7, False, 9, 4096, 8192), (120, True, 1, 10, 7)])
def test_tiles_equal_pairs(spark, odd_data, monkeypatch, k, exclude, held, seeds, rows):
    """Blocks of queries by lanes of rows, NaN, infinities and ties included."""
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", held)
    monkeypatch.setattr(knn, "SEEDS", seeds)
    monkeypatch.setattr("kinfold.operators.nearest.TILE_ROWS", rows)
    asked = odd_data.where("id % 3 = 0 OR id >= 90").select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))
    assert knn.l2_in_blocks(odd_data, asked, k) is None
    got = knn.knn_exact(odd_data, asked, k, exclude_self=exclude)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert exact_rows(got) == exact_rows(by_pairs(spark, odd_data, asked, k, exclude))
    want = knn.distances(odd_data, asked, "l2", exclude).where("dist <= 2 AND NOT isnan(dist)")
    assert sorted(knn.range_search(odd_data, asked, 2.0, exclude_self=exclude).collect()) == sorted(want.select("qid", "id", "dist").collect())


def test_tiles_of_vectors_of_unequal_length_raise(spark, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", 1)
    data = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])], "id long, obj array<double>")
    with pytest.raises(Exception, match="unequal length"):
        knn.knn_exact(data, ask(data).unionByName(data.select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))), 1).collect()


def scattered(spark, n=700, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, np.round(rng.normal(size=2), 1).tolist()) for i in range(n)] + [(n + i, [0.5, 0.5]) for i in range(60)]
    return frame(spark, "l2", rows).repartition(4)


@pytest.mark.parametrize("top,fan,survey", [(4, 3, 0), (1, 2, 0), (256, 32, 0), (256, 32, 1 << 20)])
def test_every_way_down_is_exact(spark, monkeypatch, top, fan, survey):
    """The tree of cells at several heights, and the survey in its place."""
    for name, value in (("TOP", top), ("FAN", fan), ("SURVEY", survey)):
        monkeypatch.setattr(pruned, name, value)
    monkeypatch.setattr(pruned, "_survey", lambda c, q, need, f=pruned._survey: f(c, q, need, survey))
    monkeypatch.setattr(pruned, "descend", lambda c, q, m, need=None, f=pruned.descend: f(c, q, m, need, top, fan))
    data = scattered(spark)
    _, assigned, cells = pivots.build_index(data, 10)
    for k in (3, 900):
        assert exact_rows(pruned.knn_pruned(assigned, cells, ask(data), k, exclude_self=True)) == exact_rows(knn.knn_exact(data, ask(data), k, exclude_self=True))
    got = pruned.range_pruned(assigned, cells, ask(data), 0.2)
    assert sorted(got.collect()) == sorted(knn.range_search(data, ask(data), 0.2).collect()) and got.count() > 900
    radii = ask(data).select("qid", F.lit(0.25).alias("radius"))
    near = knn.range_search(data, ask(data), 0.25)
    assert exact_rows(pruned.knn_approx(assigned, cells, ask(data), radii, 4)) == exact_rows(knn.top_k(near, 4))


@pytest.mark.parametrize("metric", ["edit", "tanimoto_bits"])
def test_tree_of_other_metrics(spark, monkeypatch, metric):
    monkeypatch.setattr(pruned, "descend", lambda c, q, m, need=None, f=pruned.descend: f(c, q, m, need, 2, 2))
    data = frame(spark, metric, objects(metric, 60, 5))
    chosen = pivots.pivots_fft(data, 9, metric)
    assigned = stage(pivots.assign_cells(data, chosen, metric), "t")
    cells = stage(pivots.rings(assigned, chosen), "t")
    assert len(pruned.cell_tree(cells, metric, 2, 2)) > 1
    assert exact_rows(pruned.knn_pruned(assigned, cells, ask(data), 4, metric, True)) == exact_rows(knn.knn_exact(data, ask(data), 4, metric, True))


def test_nodes_hold_their_objects(spark):
    """At every level the rings and counts cover what lies below."""
    data = scattered(spark)
    _, assigned, cells = pivots.build_index(data, 8)
    levels = pruned.cell_tree(cells, "l2", 3, 3)
    assert len(levels) >= 3
    where = assigned.select("id", "obj", "cell")
    for level in levels:
        rows = level.collect()
        assert sum(r["cnt"] for r in rows) == data.count()
        at = {r["cell"]: r for r in rows}
        for r in where.collect():
            node = at[r["cell"]]
            d = float(np.hypot(*(np.array(r["obj"]) - node["pobj"])))
            assert node["lo"] - 1e-9 <= d <= node["hi"] + 1e-9
        where = where.join(level.select("cell", "up"), "cell").select("id", "obj", F.col("up").alias("cell"))


def test_few_cells_are_read(spark):
    """What a query reads grows far slower than the cells."""
    rng = np.random.default_rng(9)
    share = []
    for n in (500, 8000):
        data = spark.createDataFrame([(i, rng.uniform(size=2).tolist()) for i in range(n)], "id long, obj array<double>")
        _, _, cells = pivots.build_index(data, 10)
        asked = data.where("id < 100").select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))
        wanted = [pruned.descend(cells, asked, "l2", 4, 16, 8), pruned._survey(cells, asked, 4)]
        share.append([w.count() / 100 for w in wanted])
    assert all(b < 2 * a + 5 and b < 40 for a, b in zip(*share))


@pytest.mark.parametrize("lane,block", [(20, 8192), (65536, 7), (15, 10)])
def test_hot_cells_are_dealt_in_tiles(spark, monkeypatch, lane, block):
    monkeypatch.setattr(pruned, "LANE_ROWS", lane)
    monkeypatch.setattr(pruned, "BLOCK_QUERIES", block)
    data = scattered(spark, 200)
    _, assigned, cells = pivots.build_index(data, 30)
    got = exact_rows(pruned.knn_pruned(assigned, cells, ask(data), 5, exclude_self=True))
    assert got == exact_rows(knn.knn_exact(data, ask(data), 5, exclude_self=True))
