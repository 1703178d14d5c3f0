"""Top-k over a stream: of insertions, with the k nearest of each query as state, or of changes, with lists as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kinfold.functions.metrics import Metric, l2, usable
from kinfold.operators.knn import distances, knn_exact, l2_in_blocks, top_k
from kinfold.operators.updates import knn_dynamic
from kinfold.plans.pairs import BROADCAST_QUERIES
from kinfold.plans.pruned import knn_pruned, knn_searched
from kinfold.plans.staging import delete_path, exists, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pairs that a task gathers before it keeps k of each query.
HELD = 1 << 20
#: The time of a change table that every change is within.
END = "9999-12-31"


def _smallest(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k of each query in order of (dist, id); NaN is the largest distance."""
    return pairs.sort_values(["dist", "id"], na_position="last", kind="stable").groupby("qid", sort=False).head(k)


def partial_lists(data: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """(qid, id, dist): each query's k nearest rows of every task, or every full buffer of one, before anything is shuffled.

    ``data`` may be a stream.  Euclidean distances go by matrix products; of other
    metrics a task keeps k pairs a query at most, whenever it has gathered HELD.
    """
    found = l2_in_blocks(data, queries, k) if metric in ("l2", l2) else None
    if found is not None:
        return found
    near = distances(data, queries, metric)

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) > HELD:
                held = [_smallest(pd.concat(held), k)]
                if len(held[0]) > HELD // 2:  # more than fits beside what comes: it goes on as it is
                    yield held.pop()
        if held:
            yield _smallest(pd.concat(held), k)

    return near.mapInPandas(best, near.schema)


class _TopK(StatefulProcessor):
    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "ids array<bigint>, dists array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids, dists = self.best.get() if self.best.exists() else ([], [])
        best = pd.DataFrame({"id": pd.Series(list(ids), dtype="int64"), "dist": pd.Series(list(dists), dtype="float64")})
        for part in rows:
            best = pd.concat([best, part[["id", "dist"]]]).sort_values(["dist", "id"], na_position="last").head(self.k)
        ids, dists = best["id"].tolist(), best["dist"].tolist()
        self.best.update((ids, dists))
        yield pd.DataFrame({"qid": key[0], "rank": range(1, len(ids) + 1), "id": ids, "dist": dists, "exact": True})

    def close(self) -> None:
        pass


def stream_topk(stream: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """(qid, rank, id, dist, exact): a query's whole list whenever it got arrivals, in update mode.

    For insertions only: a list can't be refilled when one of its members is deleted;
    stream_lists() takes changes.  Tasks reduce a batch to k pairs a query before the
    state is touched, which is k pairs a query itself.  Arrivals that repeat count each.
    Needs the RocksDB state store; queries are broadcast, so they have to be as few as
    a live dashboard holds (20,000).
    """
    if queries.limit(BROADCAST_QUERIES + 1).count() > BROADCAST_QUERIES:
        raise ValueError("too many standing queries to broadcast")
    return partial_lists(stream, queries, k, metric).groupBy("qid").transformWithStateInPandas(
        statefulProcessor=_TopK(k),
        outputStructType="qid bigint, rank int, id bigint, dist double, exact boolean",
        outputMode="Update",
        timeMode="None",
    )


def settled_topk(stream: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str, metric: str | Metric = "l2") -> DataFrame:
    """The last list of each query once all arrivals that are there were taken.

    Batches are written under ``path`` by their number, so one that is run again
    adds nothing.  The state store has to be RocksDB; it is set while the stream starts.
    More queries than a task holds keep their lists as tables instead of state.
    """
    spark = stream.sparkSession
    if queries.limit(BROADCAST_QUERIES + 1).count() > BROADCAST_QUERIES:
        return _settled_lists(stream, queries, k, path, checkpoint, metric)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.conf.set(key, ROCKSDB)
    try:
        (
            stream_topk(stream, queries, k, metric).writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    lists = spark.read.parquet(path)
    last = lists.groupBy("qid").agg(F.max("batch").alias("batch"))
    return lists.join(last, ["qid", "batch"]).drop("batch")


def _settled_lists(stream: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str, metric: str | Metric) -> DataFrame:
    """The same for any number of queries: a batch's k nearest, searched as a table, go into the lists of the batch before.

    The lists are ``path``/lists by the batch's number, two at most; a batch that is run
    again overwrites its own from those before it.
    """
    asked = usable(queries, "qid", "qobj").select("qid", "qobj")

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = knn_searched(stage(batch.select("id", "obj"), "batch"), asked, k, metric)
        former = f"{path}/lists/batch={number - 1}"
        if exists(spark, former):
            both = spark.read.parquet(former).select("qid", "id", "dist").unionByName(found.select("qid", "id", "dist"))
            found = top_k(both, k)
        found.write.mode("overwrite").parquet(f"{path}/lists/batch={number}")
        delete_path(spark, f"{path}/lists/batch={number - 2}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return lists(stream.sparkSession, path)


def _changed(changes: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, op, obj): of the batch's ids the last change of all so far, by (ts, seq); an older one may come late."""
    ids = batch.select("id").distinct()
    last = F.max_by(F.struct("op", "obj"), F.struct("ts", "seq"))
    return changes.join(ids, "id", "left_semi").groupBy("id").agg(last.alias("last")).select("id", "last.op", "last.obj")


def stream_lists(
    stream: DataFrame, base: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str, metric: str | Metric = "l2", exclude_self: bool = False,
    index: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> StreamingQuery:
    """Starts a query that keeps each query's list right under a stream of changes (seq, ts, op, id, obj) to ``base``.

    A batch's changes go to the table ``path``/changes.  Lists that hold none of the
    batch's ids meet its inserted objects alone, k of every task.  A list with a
    member that was deleted or moved is refilled: its query searches the base with all
    changes so far, over (pivots, assigned, cells) of the base where an ``index`` is given.
    The lists are ``path``/lists by the batch's number, -1 for the base's; a batch
    that is run again overwrites its folders, from the lists before it.  The folder
    before those goes, so there are two at most; lists() reads the newest.
    """
    spark = stream.sparkSession
    asked = usable(queries, "qid", "qobj").select("qid", "qobj")

    def write(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(f"{path}/lists/batch={number}")

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("seq", "ts", "op", "id", "obj").write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        changes = spark.read.parquet(f"{path}/changes").where(F.col("batch").cast("long") <= number).drop("batch")
        own = spark.read.parquet(f"{path}/changes/batch={number}")
        before = spark.read.parquet(f"{path}/lists/batch={number - 1}")
        last = stage(_changed(changes, own), "last")
        touched = stage(before.join(last.select("id"), "id", "left_semi").select("qid").distinct(), "touched")
        stale = asked.join(touched, "qid", "left_semi")
        still = asked.join(touched, "qid", "left_anti")
        new = knn_searched(last.where("op = 'insert'").select("id", "obj"), still, k, metric, exclude_self, knn_exact)
        kept = before.join(touched, "qid", "left_anti")
        found = top_k(kept.select("qid", "id", "dist").unionByName(new.select("qid", "id", "dist")), k)
        if not touched.isEmpty():
            found = found.unionByName(knn_dynamic(base, changes, END, stale, k, metric, exclude_self, index))
        write(found, number)
        delete_path(spark, f"{path}/lists/batch={number - 2}")

    if not exists(spark, checkpoint):
        write(knn_exact(base, asked, k, metric, exclude_self) if index is None else knn_pruned(*index[1:], asked, k, metric, exclude_self), -1)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lists(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id, dist, exact): the newest lists of stream_lists() that are written whole."""
    batches = spark.read.parquet(f"{path}/lists").select(F.col("batch").cast("long").alias("batch")).distinct()
    whole = [r["batch"] for r in batches.collect() if exists(spark, f"{path}/lists/batch={r['batch']}/_SUCCESS")]  # three at most
    return spark.read.parquet(f"{path}/lists/batch={max(whole)}")
