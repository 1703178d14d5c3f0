"""Indexes with changes merged in, arrivals that repeat, and streams that rebuild their index."""

import random

import pytest
from pyspark.sql import functions as F
from test_search import ask, brute, frame, objects, sorted_rows

from kinfold.operators import knn, pivots, updates
from kinfold.plans import pruned
from kinfold.plans.staging import stage
from kinfold.streaming import arrivals


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_merged_on_read(spark, seed):
    """Inserts, deletes, updates of the same id and changes of the future, over cells that were split."""
    rng = random.Random(seed)
    rows = objects("l2", 120, seed)
    base = rows[:90]
    changes, alive = [], dict(base)
    for seq in range(150):
        i, ts = rng.randrange(120), seq // 3
        op, obj = ("delete", None) if rng.random() < 0.4 else ("insert", rng.choice(rows)[1])
        changes.append((seq, ts, op, i, obj))
    for _, ts, op, i, obj in changes:
        if ts <= 30:
            alive.pop(i, None)
            if op == "insert":
                alive[i] = obj
    table = spark.createDataFrame(changes, "seq long, t int, op string, id long, obj array<double>").withColumn("ts", F.timestamp_seconds("t")).repartition(3)
    data = frame(spark, "l2", base)
    index = pivots.build_index(data, 4)
    as_of = F.timestamp_seconds(F.lit(30))
    queries = ask(frame(spark, "l2", rows))
    want = brute("l2", sorted(alive.items()), [r for r in rows if r[0] % 5 == 0], 6, True)
    assert sorted_rows(updates.knn_dynamic(data, table, as_of, queries, 6, exclude_self=True, index=index)) == want
    assert sorted_rows(updates.knn_dynamic(data, table, as_of, queries, 6, exclude_self=True)) == want
    assigned, cells = updates.merged(index[1], index[2], index[0], table, as_of)
    assert assigned.count() == len(alive) == cells.agg(F.sum("cnt")).first()[0]


@pytest.mark.parametrize("split", [False, True])
def test_repeated_arrivals_count_each(spark, split):
    data = frame(spark, "l2", objects("l2", 40, 3))
    chosen = pivots.pivots_fft(data, 3)
    assigned = pivots.assign_cells(data, chosen)
    cells = pivots.rings(assigned, chosen)
    if split:
        assigned, cells = pivots.split_cells(assigned, cells, 5)
    late = frame(spark, "l2", [(100, [1.0, 1.0]), (100, [1.0, 1.0]), (101, [9.0, 1.0])])
    grown, wide = (stage(t, "t") for t in updates.insert_direct(assigned, stage(cells, "t"), chosen, late))
    assert grown.count() == 43
    assert sorted_rows(pruned.knn_pruned(grown, wide, ask(data), 5)) == sorted_rows(knn.knn_exact(data.unionByName(late), ask(data), 5))


def _stream(spark, data, path):
    return spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@pytest.mark.parametrize("crash", [None, "admit_safe", "compact", "write_version", "publish", "after"])
def test_stream_compacts_and_survives_crashes(spark, tmp_path, monkeypatch, crash):
    """A crash between each two steps of a batch: what is run again leaves the same index, with nothing lost or twice."""
    path = f"file://{tmp_path}"
    rows = objects("l2", 80, 6)
    data = frame(spark, "l2", rows)
    late = data.where("id >= 50")
    for part in range(3):
        late.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arrivals.create_index(*pivots.build_index(data.where("id < 50"), 8), f"{path}/index")
    arrivals.create_index(*pivots.build_index(data.where("id < 9"), 8), f"{path}/index")  # there is one already
    calls = {"n": 0}

    def broken(f, late_too):
        def run(*args, **kwargs):
            calls["n"] += 1
            if calls["n"] != 2:
                return f(*args, **kwargs)
            if late_too:
                f(*args, **kwargs)
            raise RuntimeError("lost")

        return run

    if crash:
        where = updates if crash in ("write_version", "publish", "after") else arrivals
        name = "publish" if crash == "after" else crash
        monkeypatch.setattr(where, name, broken(getattr(where, name), crash in ("after", "write_version", "admit_safe")))
    run = lambda: arrivals.stream_compacting(_stream(spark, data, path), f"{path}/index", f"{path}/check", 0, 8).awaitTermination()
    if crash:
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    run()
    version, taken = updates.current(spark, f"{path}/index")
    assert version >= 2 and taken >= 0
    asked = [r for r in rows if r[0] % 5 == 0]
    assert sorted_rows(arrivals.knn_current(spark, f"{path}/index", ask(data), 4, exclude_self=True)) == brute("l2", rows, asked, 4, True)
