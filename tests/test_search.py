"""Search by brute force, by cells and after changes, on random data with ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import metrics
from kinfold.operators import calibrate, knn, pivots, updates
from kinfold.plans import pairs, pruned
from kinfold.plans.staging import stage

KINDS = {"l2": "array<double>", "edit": "string", "tanimoto_bits": "array<bigint>"}


def objects(metric, n, seed):
    rng = random.Random(seed)
    make = {
        "l2": lambda: [float(rng.randint(0, 5)), float(rng.randint(0, 5))],
        "edit": lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 5))),
        "tanimoto_bits": lambda: [rng.randint(0, 15)],
    }[metric]
    return [(i, make()) for i in range(n)]


def frame(spark, metric, rows):
    return spark.createDataFrame(rows, f"id long, obj {KINDS[metric]}")


def ask(data):
    return data.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))


def sorted_rows(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["dist"], 9)) for r in df.collect())


def plain(metric, a, b):
    if metric == "l2":
        return float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))))
    if metric == "tanimoto_bits":
        u = bin(a[0] | b[0]).count("1")
        return 1 - bin(a[0] & b[0]).count("1") / u if u else 0.0
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            e, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, e + (x != y))
    return float(d[-1])


def brute(metric, data, queries, k, exclude_self):
    out = []
    for q, o in queries:
        near = sorted((plain(metric, x, o), i) for i, x in data if not (exclude_self and i == q))[:k]
        out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("metric", KINDS)
@pytest.mark.parametrize("k,m,exclude", [(1, 1, False), (4, 5, True), (60, 3, True)])
def test_pruned_is_exact(spark, metric, k, m, exclude):
    rows = objects(metric, 45, k + m)
    data = frame(spark, metric, rows)
    chosen = pivots.pivots_fft(data, m, metric)
    assigned = pivots.assign_cells(data, chosen, metric)
    want = brute(metric, rows, [r for r in rows if r[0] % 5 == 0], k, exclude)
    assert sorted_rows(knn.knn_exact(data, ask(data), k, metric, exclude)) == want
    ring = pivots.rings(assigned, chosen)
    assert sorted_rows(pruned.knn_pruned(assigned, ring, ask(data), k, metric, exclude)) == want
    small, cells = pivots.split_cells(assigned, ring, 6, metric)
    assert small.count() == 45 and cells.agg(F.sum("cnt")).first()[0] == 45
    assert sorted_rows(pruned.knn_pruned(small, cells, ask(data), k, metric, exclude)) == want


def test_sampled_pivots_are_farthest_first(spark):
    for metric in KINDS:
        data = frame(spark, metric, objects(metric, 40, 2))
        want = [tuple(r) for r in pivots.pivots_fft(data, 7, metric).collect()]
        got = sorted(tuple(r) for r in pivots.pivots_sampled(data, 7, metric).collect())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert pivots.pivots_sampled(data.limit(0), 3, metric).count() == 0
    assert pivots.pivots_sampled(data, 1, metric).count() == 1


def test_range_pruned(spark):
    data = frame(spark, "l2", objects("l2", 60, 3))
    chosen = pivots.pivots_fft(data, 4)
    assigned = pivots.assign_cells(data, chosen)
    found = pruned.range_pruned(assigned, pivots.rings(assigned, chosen), ask(data), 2.0)
    want = knn.range_search(data, ask(data), 2.0)
    assert sorted(found.collect()) == sorted(want.collect()) and want.count() > 12


def test_blocks_equal_broadcast(spark):
    data = frame(spark, "l2", objects("l2", 30, 4))
    one = pairs.against_all(data, ask(data)).select("id", "qid")
    other = pairs.against_all(data, ask(data), most=2, block=2).select("id", "qid")
    assert sorted(one.collect()) == sorted(other.collect()) and one.count() == 180


def test_many_queries_are_not_copied_for_few_cells(spark):
    cells = frame(spark, "l2", objects("l2", 4, 4))
    asked = frame(spark, "l2", objects("l2", 60, 5)).select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))
    met = pairs.against_all(cells, asked, most=20, block=5)
    assert sorted(met.select("id", "qid").collect()) == [(i, q) for i in range(4) for q in range(60)]
    assert "Generate" not in met._jdf.queryExecution().toString()  # no query stands in every slice


@pytest.mark.parametrize("metric", KINDS)
def test_metric_axioms(spark, metric):
    rows = objects(metric, 14, 9)
    df = frame(spark, metric, rows)
    d = {(r["qid"], r["id"]): r["dist"] for r in knn.distances(df, df.select(F.col("id").alias("qid"), F.col("obj").alias("qobj")), metric).collect()}
    for a, x in rows:
        assert d[a, a] == 0
        for b, y in rows:
            assert d[a, b] == d[b, a] and abs(d[a, b] - plain(metric, x, y)) < 1e-12
            for c, _ in rows:
                assert d[a, c] <= d[a, b] + d[b, c] + 1e-12


def test_edges(spark):
    assert spark.range(1).select(metrics.tanimoto_bits(F.array(F.lit(0)), F.array(F.lit(0)))).first()[0] == 0
    assert spark.range(1).select(metrics.tanimoto_set(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 0
    with pytest.raises(Exception, match="unequal length"):
        spark.range(1).select(metrics.l2(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()
    empty = spark.createDataFrame([], "id long, obj array<double>")
    assert pivots.pivots_fft(empty, 3).count() == 0
    assert knn.knn_exact(empty, ask(empty), 3).count() == 0
    same = frame(spark, "l2", [(i, [1.0, 1.0]) for i in range(5)])
    assert pivots.pivots_fft(same, 3).count() == 1


def test_validity_audit(spark):
    data = frame(spark, "l2", objects("l2", 20, 5))
    good = knn.knn_exact(data, ask(data), 3)
    knn.require_valid(good, ask(data), 20, 3)
    for bad in (good.where("rank < 3"), good.withColumn("dist", F.lit(-1.0)), good.withColumn("rank", F.lit(1)), good.where("qid > 0")):
        with pytest.raises(ValueError, match="not valid"):
            knn.require_valid(bad, ask(data), 20, 3)


def test_changes_stay_exact(spark):
    rows = objects("l2", 60, 6)
    data = frame(spark, "l2", rows)
    base, late = data.where("id < 40"), data.where("id >= 40")
    chosen = pivots.pivots_fft(base, 3)
    assigned = pivots.assign_cells(base, chosen)
    ring = pivots.rings(assigned, chosen)
    asked = [r for r in rows if r[0] % 5 == 0]
    want = brute("l2", rows, asked, 4, True)
    assert sorted_rows(updates.knn_buffered(assigned, ring, late, ask(data), 4, exclude_self=True)) == want
    grown, wide = updates.insert_direct(assigned, ring, chosen, late)
    assert sorted_rows(pruned.knn_pruned(grown, wide, ask(data), 4, exclude_self=True)) == want
    less = updates.delete(grown, data.where("id % 3 = 1").select("id"))
    rest = [r for r in rows if r[0] % 3 != 1]
    for cells in (wide, updates.recount(less, wide)):
        assert sorted_rows(pruned.knn_pruned(less, cells, ask(data), 4, exclude_self=True)) == brute("l2", rest, asked, 4, True)
    safe = updates.admit_safe(late, ring, chosen)
    both = assigned.unionByName(safe.where("admitted").drop("admitted"))
    waiting = safe.where("NOT admitted").select("id", "obj")
    counts = updates.recount(both, ring)
    assert sorted_rows(updates.knn_buffered(both, counts, waiting, ask(data), 4, exclude_self=True)) == want


def test_compact_versions(spark, tmp_path):
    data = frame(spark, "l2", objects("l2", 30, 7))
    chosen = pivots.pivots_fft(data, 2)
    assigned = pivots.assign_cells(data.where("id < 20"), chosen)
    late = data.where("id >= 20")
    path = f"file://{tmp_path}/index"
    assert not updates.compact(assigned, late, 10, 10, path, 1)
    assert updates.compact(assigned, late, 9, 10, path, 1) and updates.current_version(spark, path) == 1
    assert updates.compact(assigned, late, 5, 10, path, 2) and updates.current_version(spark, path) == 2
    found = spark.read.parquet(f"{path}/v2/objects")
    cells = spark.read.parquet(f"{path}/v2/cells")
    assert sorted_rows(pruned.knn_pruned(found, cells, ask(data), 3)) == sorted_rows(knn.knn_exact(data, ask(data), 3))


def test_learned_radius_is_audited(spark):
    rng = np.random.default_rng(1)
    data = frame(spark, "l2", [(i, rng.normal(size=2).tolist()) for i in range(200)])
    chosen = pivots.pivots_fft(data, 4)
    assigned = pivots.assign_cells(data, chosen)
    ring = pivots.rings(assigned, chosen)
    calib = calibrate.calibration(data, chosen, ask(data), 5)
    model = calibrate.fit_radius(calib)
    nearest = calibrate.nearest_pivot(ask(data), chosen)
    exact = knn.knn_exact(data, ask(data), 5)
    slope, intercept = np.polyfit(*np.array([(r["nearest_pivot_dist"], r["kth_dist"]) for r in calib.collect()]).T, 1)
    got = model.first()
    assert np.allclose([got["slope"], got["intercept"]], [slope, intercept])
    for scales, full in ((0.0, False), (50.0, True)):
        approx = pruned.knn_approx(assigned, ring, ask(data), calibrate.predict_radius(nearest, model, scales), 5)
        recall = calibrate.recall_at_k(approx, exact).agg(F.avg("recall")).first()[0]
        assert (recall == 1) == full and (calibrate.prune_violations(exact, approx).count() == 0) == full
        assert not approx.where("exact").count()


def test_calibrated_radius_keeps_its_promise(spark):
    """Held-out queries are covered about as often as promised; too few rows give an infinite radius."""
    rng = np.random.default_rng(4)
    data = frame(spark, "l2", [(i, rng.normal(size=2).tolist()) for i in range(2400)]).repartition(3)
    asked = data.select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))
    taught, held = asked.where("qid % 4 = 1"), asked.where("qid % 4 = 2")
    chosen = pivots.pivots_fft(data, 4)
    calib = calibrate.calibration(data, chosen, taught, 5, exclude_self=True).select("qid", "kth_dist")
    model = calibrate.fit_radius_ml(calib.join(calibrate.pivot_features(taught, chosen), "qid"), 0.9, rounds=20)
    radii = calibrate.predict_radius_ml(calibrate.pivot_features(held, chosen), model)
    _, assigned, cells = pivots.build_index(data, 50)
    recall = calibrate.recall_at_k(pruned.knn_approx(assigned, cells, held, radii, 5, exclude_self=True), knn.knn_exact(data, held, 5, exclude_self=True))
    full, mean = recall.agg(F.avg((F.col("recall") == 1).cast("int")), F.avg("recall")).first()
    assert 0.85 <= full <= 0.97 and mean >= 0.9
    few = calibrate.fit_radius_ml(calib.limit(6).join(calibrate.pivot_features(taught, chosen), "qid"), 0.9, rounds=5)
    assert calibrate.predict_radius_ml(calibrate.pivot_features(held, chosen), few).where("radius < double('inf')").count() == 0
    none = calibrate.fit_radius_ml(calib.limit(0).join(calibrate.pivot_features(taught, chosen), "qid"))
    assert none.margin == float("inf")


def test_coreset_pivots_cover(spark):
    """The covering radius is at most four times that of the exact traversal, in a fixed number of jobs."""
    rng = np.random.default_rng(5)
    points = [(i, (rng.normal(size=2) + 9 * rng.integers(0, 4, 2)).tolist()) for i in range(3000)]
    data = frame(spark, "l2", points).repartition(5)
    x = np.array([p for _, p in points])

    def radius(df):
        c = np.array([r["obj"] for r in df.collect()])
        return np.sqrt(((x[:, None] - c[None]) ** 2).sum(2)).min(1).max()

    for m in (3, 12):
        exact = pivots.pivots_fft(data, m)
        for chunk in (100, 4096):
            core = pivots.pivots_coreset(data, m, chunk)
            assert core.count() == m and radius(core) <= 4 * radius(exact) + 1e-9
    same = frame(spark, "l2", [(i, [1.0, 1.0]) for i in range(30)])
    assert pivots.pivots_coreset(same, 4).count() == 1 and pivots.pivots_coreset(same.limit(0), 4).count() == 0


def vectors(seed, n, odd=()):
    """Vectors of three numbers with ties, and odd ones: NaN, infinities, -0.0, numbers whose squares overflow."""
    rng = random.Random(seed)
    rows = [(i, [float(rng.randint(0, 4)) for _ in range(3)]) for i in range(n)]
    for i, v in enumerate(odd):
        rows[rng.randrange(n)] = (n + i, v)
    return rows


ODD = [[float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0], [float("-inf"), 1.0, 1.0], [-0.0, -0.0, 1.0], [1e200, 0.0, 0.0], [1e200, 1.0, 0.0]]


def by_pairs(spark, data, asked, k, exclude):
    return knn.top_k(knn.distances(data, asked, "l2", exclude), k)


def exact_rows(df):
    return sorted((r["qid"], r["rank"], r["id"], repr(r["dist"])) for r in df.collect())


@pytest.mark.parametrize("k,exclude,batch", [(2, True, 3), (7, False, 10000), (90, True, 7)])
def test_blocks_equal_pairs_with_odd_numbers(spark, k, exclude, batch):
    rows = vectors(k, 60, ODD) + [(500, None), (501, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0])]
    data = spark.createDataFrame(rows, "id long, obj array<double>").repartition(2)
    asked = data.where("id % 3 = 0 OR id >= 60").select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = exact_rows(knn.knn_exact(data, asked, k, exclude_self=exclude))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == exact_rows(by_pairs(spark, data, asked, k, exclude)) and len(got) > 40
    want = knn.distances(data, asked, "l2", exclude).where("dist <= 2 AND NOT isnan(dist)")
    assert sorted(knn.range_search(data, asked, 2.0, exclude_self=exclude).collect()) == sorted(want.select("qid", "id", "dist").collect())


def test_one_nan_loses_no_neighbour(spark):
    data = spark.createDataFrame([(0, [float("nan"), 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.0])], "id long, obj array<double>").coalesce(1)
    asked = spark.createDataFrame([(9, [0.2, 0.0])], "qid long, qobj array<double>")
    assert [r["id"] for r in knn.knn_exact(data, asked, 2).orderBy("rank").collect()] == [1, 2]


def test_string_ids(spark):
    rows = [(f"v{i}", v) for i, v in vectors(5, 30)]
    data = spark.createDataFrame(rows, "id string, obj array<double>")
    asked = data.where("id LIKE '%1'").select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))
    assert exact_rows(knn.knn_exact(data, asked, 4, exclude_self=True)) == exact_rows(by_pairs(spark, data, asked, 4, True))


def test_pruned_with_odd_numbers(spark):
    data = spark.createDataFrame(vectors(8, 80, ODD), "id long, obj array<double>")
    asked = data.where("id % 3 = 0 OR id >= 80").select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))
    for _, assigned, cells in (pivots.build_index(data, 10), pivots.build_index(data, 4)):
        for k in (3, 100):
            want = exact_rows(knn.knn_exact(data, asked, k, exclude_self=True))
            assert exact_rows(pruned.knn_pruned(assigned, cells, asked, k, exclude_self=True)) == want


@pytest.mark.parametrize("metric,seed", [("l2", 1)])
def test_changes_after_splits_stay_exact(spark, metric, seed):
    """Inserts, admissions, deletes and a rebuild over cells split twice."""
    rows = objects(metric, 90, 20 + seed)
    data = frame(spark, metric, rows)
    base, late = data.where("id < 55"), data.where("id >= 55")
    chosen = pivots.pivots_fft(base, 3, metric)
    assigned = pivots.assign_cells(base, chosen, metric)
    cells = pivots.rings(assigned, chosen)
    for target in (12, 4):
        assigned, cells = pivots.split_cells(assigned, cells, target, metric, most=3)
    numbers = [r["cell"] for r in cells.collect()]
    assert len(numbers) == len(set(numbers)) > 5 and max(numbers) >= 1024
    asked = [r for r in rows if r[0] % 5 == 0]
    want = brute(metric, rows, asked, 4, True)
    cells = stage(cells, "cells")
    grown, wide = (stage(t, "t") for t in updates.insert_direct(assigned, cells, chosen, late, metric))
    assert grown.count() == 90 and wide.agg(F.sum("cnt")).first()[0] == 90
    assert sorted_rows(pruned.knn_pruned(grown, wide, ask(data), 4, metric, True)) == want
    spots = {r["cell"]: r["pobj"] for r in wide.collect()}
    for r in grown.collect():
        assert abs(plain(metric, r["obj"], spots[r["cell"]]) - r["pdist"]) < 1e-12
    safe = stage(updates.admit_safe(late, cells, chosen, metric), "t")
    assert 0 < safe.where("admitted").count() and safe.count() == 35
    both = assigned.unionByName(safe.where("admitted").drop("admitted"))
    found = updates.knn_buffered(both, updates.recount(both, cells), safe.where("NOT admitted").select("id", "obj"), ask(data), 4, metric, True)
    assert sorted_rows(found) == want
    less = stage(updates.delete(grown, data.where("id % 3 = 1").select("id")), "t")
    rest = [r for r in rows if r[0] % 3 != 1]
    assert sorted_rows(pruned.knn_pruned(less, updates.recount(less, wide), ask(data), 4, metric, True)) == brute(metric, rest, asked, 4, True)
    _, new, ring = updates.rebuilt(less, late.where("id % 3 = 1"), 5, metric)
    every = [r for r in rows if r[0] % 3 != 1 or r[0] >= 55]
    assert sorted_rows(pruned.knn_pruned(new, ring, ask(data), 4, metric, True)) == brute(metric, every, asked, 4, True)


def test_index_adapts(spark):
    """Cells stay small whatever the number of pivots, but for those of equal objects."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(900)] + [(i, [9.0, 9.0]) for i in range(900, 1000)]
    data = frame(spark, "l2", rows)
    pivots_most, pivots.MOST_PARTS = pivots.choose_m, 4
    try:
        pivots.choose_m = lambda n, target: 3
        _, assigned, cells = pivots.build_index(data, 5)
    finally:
        pivots.choose_m, pivots.MOST_PARTS = pivots_most, 64
    assert assigned.count() == 1000 and cells.where("cnt > 20").select("cnt").collect() == [(100,)]
    roots = {r[0] for r in cells.select(pivots.root_cell(F.col("cell"))).collect()}
    assert roots <= {0, 1, 2} and cells.where("cell >= 1048576").count() > 0
    assert sorted_rows(pruned.knn_pruned(assigned, cells, ask(data), 6)) == sorted_rows(knn.knn_exact(data, ask(data), 6))


def test_long_queries_are_not_broadcast(spark):
    data = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id long, obj string")
    few = pairs.against_all(data, data.select(F.col("id").alias("qid"), F.col("obj").alias("qobj")), most_bytes=300)
    assert "NestedLoop" not in few._jdf.queryExecution().toString() and few.count() == 400


def test_compact_after_a_crash(spark, tmp_path):
    data = frame(spark, "l2", objects("l2", 30, 7))
    chosen = pivots.pivots_fft(data, 2)
    assigned = pivots.assign_cells(data.where("id < 20"), chosen)
    path = f"file://{tmp_path}/index"
    data.write.parquet(f"{path}/v1/objects")  # left by a run that ended before its pointer
    assert updates.current_version(spark, path) is None
    assert updates.compact(assigned, data.where("id >= 20"), 5, 10, path, 1) and updates.current_version(spark, path) == 1
    found, cells = spark.read.parquet(f"{path}/v1/objects"), spark.read.parquet(f"{path}/v1/cells")
    assert sorted_rows(pruned.knn_pruned(found, cells, ask(data), 3)) == sorted_rows(knn.knn_exact(data, ask(data), 3))
    with pytest.raises(ValueError, match="published"):
        updates.compact(assigned, data, 5, 10, path, 1)


def test_split_sees_every_object_of_a_cell(spark, monkeypatch):
    """The farthest object of a cell parts it, whatever a sample of the cell would hold; ties go to the smaller id."""
    monkeypatch.setattr(pivots, "MOST_SAMPLE", 8)
    rows = [(i, [float(i % 7), 0.0]) for i in range(200)] + [(300, [50.0, 0.0]), (299, [50.0, 0.0]), (400, [20.0, 0.0])]
    data = spark.createDataFrame(rows, "id long, obj array<double>").repartition(3)
    chosen = pivots.pivots_fft(data, 1)
    assigned = pivots.assign_cells(data, chosen)
    _, cells = pivots.split_cells(assigned, pivots.rings(assigned, chosen), 50, most=3, sample=None)
    got = sorted((r["cell"], r["pobj"][0], r["cnt"]) for r in cells.collect())
    assert got == [(1024, 0.0, 200), (1025, 50.0, 2), (1026, 20.0, 1)]
