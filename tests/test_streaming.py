"""Streams give what a batch over the same rows gives; a repeated batch adds nothing."""

import pytest
from pyspark.sql import functions as F
from test_search import ask, frame, objects, sorted_rows

from kinfold.operators import knn, pivots, updates
from kinfold.streaming.arrivals import arrived, knn_arrived, stream_updates
from kinfold.streaming import topk
from kinfold.streaming.topk import partial_lists, stream_topk


def _arrive(spark, tmp_path, data, name, lo, hi):
    data.where(f"id >= {lo} AND id < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")


def test_updates(spark, tmp_path):
    data = frame(spark, "l2", objects("l2", 60, 8))
    chosen = pivots.pivots_fft(data.where("id < 30"), 3)
    assigned = pivots.assign_cells(data.where("id < 30"), chosen)
    ring = pivots.rings(assigned, chosen)
    for lo, hi in ((30, 45), (45, 60)):
        _arrive(spark, tmp_path, data, "in", lo, hi)
        stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
        stream_updates(stream, ring, chosen, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    want = updates.admit_safe(data.where("id >= 30"), ring, chosen)
    for name, flag in (("admitted", True), ("buffer", False)):
        got = sorted(r["id"] for r in arrived(spark, f"{tmp_path}/out", name).collect())
        assert got == sorted(r["id"] for r in want.where(F.col("admitted") == flag).collect())
    # the same arrivals once more, as a stream that lost its checkpoint
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_updates(stream, ring, chosen, f"{tmp_path}/out", f"{tmp_path}/check2").awaitTermination()
    assert arrived(spark, f"{tmp_path}/out", "admitted").count() == want.where("admitted").count()


def test_topk(spark, tmp_path):
    data = frame(spark, "l2", objects("l2", 40, 9))
    latest = {}

    def keep(batch, number):
        for r in batch.collect():
            latest.setdefault(r["qid"], {})[(number, r["rank"])] = r

    for lo, hi in ((0, 20), (20, 40)):
        _arrive(spark, tmp_path, data, "in", lo, hi)
        stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
        query = stream_topk(stream, ask(data), 4).writeStream.foreachBatch(keep).outputMode("update")
        query.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = []
    for q, found in latest.items():
        last = max(n for n, _ in found)
        got += [(q, rank, r["id"], round(r["dist"], 9)) for (n, rank), r in found.items() if n == last]
    assert sorted(got) == sorted_rows(knn.knn_exact(data, ask(data), 4))


def test_search_over_index_admitted_and_waiting(spark, tmp_path):
    data = frame(spark, "l2", objects("l2", 60, 8))
    chosen = pivots.pivots_fft(data.where("id < 30"), 3)
    assigned = pivots.assign_cells(data.where("id < 30"), chosen)
    assigned, ring = pivots.split_cells(assigned, pivots.rings(assigned, chosen), 6)
    _arrive(spark, tmp_path, data, "in", 30, 60)
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    stream_updates(stream, ring, chosen, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    for k in (4, 80):
        found = knn_arrived(assigned, ring, f"{tmp_path}/out", ask(data), k)
        assert sorted_rows(found) == sorted_rows(knn.knn_exact(data, ask(data), k))


@pytest.mark.parametrize("metric", ["l2", "edit"])
def test_tasks_keep_k_a_query(spark, metric):
    rows = objects(metric, 90, 3)
    data = frame(spark, metric, rows).repartition(3)
    data = data.unionByName(data.where("id < 5"))  # repeated arrivals count each
    asked = ask(data.where("id >= 5"))
    for held in (topk.HELD, 50):
        part = partial_lists(data, asked, 4, metric)
        if held == topk.HELD:
            assert part.count() <= part.rdd.getNumPartitions() * asked.count() * 4
        assert sorted_rows(knn.top_k(part, 4)) == sorted_rows(knn.knn_exact(data, asked, 4, metric))


def _changes(spark, data):
    """Four batches of changes in order of seq: inserts, moves, deletions, a change that comes late, a repeat and a null."""
    far = F.transform("obj", lambda x: x + 3)
    kind = [("insert", 30, 45, "obj"), ("delete", 0, 12, "obj"), ("insert", 8, 20, "far"), ("insert", 45, 60, "obj")]
    out = []
    for n, (op, lo, hi, what) in enumerate(kind):
        part = data.where(f"id >= {lo} AND id < {hi}").withColumn("far", far)
        out.append(part.select((F.lit(100 * n) + F.col("id")).alias("seq"), F.timestamp_seconds(F.lit(1000 * (n + 1))).alias("ts"), F.lit(op).alias("op"), "id", F.col(what).alias("obj")))
    late = data.where("id IN (30, 9)").select(F.lit(1).cast("long").alias("seq"), F.timestamp_seconds(F.lit(5)).alias("ts"), F.lit("delete").alias("op"), "id", "obj")
    none = data.where("id = 25").select(F.lit(2).cast("long").alias("seq"), F.timestamp_seconds(F.lit(9)).alias("ts"), F.lit("insert").alias("op"), "id", F.lit(None).cast(data.schema["obj"].dataType).alias("obj"))
    out[3] = out[3].unionByName(late).unionByName(none).unionByName(out[3].where("id = 45"))
    return out


@pytest.mark.parametrize("indexed,crash", [(True, None), (False, "knn_exact"), (True, "delete_path")])
def test_lists_follow_changes(spark, tmp_path, monkeypatch, indexed, crash):
    data = frame(spark, "l2", objects("l2", 60, 8))
    base, asked = data.where("id < 30"), ask(data)
    index = pivots.build_index(base, 6) if indexed else None
    batches, path = _changes(spark, data), f"{tmp_path}/out"
    every = None
    for n, part in enumerate(batches):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in")
        run = lambda: topk.stream_lists(stream, base, asked, 4, path, f"{tmp_path}/check", exclude_self=True, index=index)  # noqa: B023, E731
        if crash and n in (1, 3):
            with monkeypatch.context() as m:
                m.setattr(topk, crash, lambda *a, **k: 1 / 0)
                with pytest.raises(Exception, match="division by zero"):
                    run().awaitTermination()
        run().awaitTermination()
        every = part if every is None else every.unionByName(part)
        want = updates.knn_dynamic(base, every, topk.END, asked, 4, exclude_self=True)
        assert sorted_rows(topk.lists(spark, path)) == sorted_rows(want)
