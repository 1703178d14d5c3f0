"""Streaming arrivals into an index and its buffer, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions.metrics import Metric
from kinfold.operators.updates import admit_safe, compact, current, knn_buffered, publish, read_version, recount, write_version
from kinfold.plans.staging import exists, stage


def stream_updates(stream: DataFrame, cells: DataFrame, pivots: DataFrame, path: str, checkpoint: str, metric: str | Metric = "l2") -> StreamingQuery:
    """Starts a query that deals arrivals (id, obj) to ``path``/admitted and ``path``/buffer.

    Admitted arrivals fall inside the ring of their cell and so leave the index sound
    as it is; others wait for a rebuild.  Each batch writes folders of its own number
    and overwrites them when it is run again, so a repeated batch adds nothing.  All
    arrivals that are there are taken, then the query ends.
    """

    def deal(batch: DataFrame, number: int) -> None:
        placed = admit_safe(batch.select("id", "obj"), cells, pivots, metric).persist()
        for name, flag in (("admitted", True), ("buffer", False)):
            part = placed.where(F.col("admitted") == flag).drop("admitted")
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        placed.unpersist()

    return (
        stream.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def arrived(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(id, obj, cell, pdist) of what a stream has put into 'admitted' or 'buffer'."""
    return spark.read.parquet(f"{path}/{name}").drop("batch")


def knn_arrived(assigned: DataFrame, cells: DataFrame, path: str, queries: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """Top-k over the index, the arrivals that a stream has admitted to it so far, and those in its buffer.

    Admitted arrivals lie inside the rings, so only the counts are taken anew; the
    buffer is searched as knn_buffered() does.
    """
    spark = assigned.sparkSession
    grown = stage(assigned.unionByName(arrived(spark, path, "admitted").select(*assigned.columns)), "grown")
    waiting = arrived(spark, path, "buffer").select("id", "obj")
    return knn_buffered(grown, recount(grown, cells), waiting, queries, k, metric, exclude_self)


def create_index(pivots: DataFrame, assigned: DataFrame, cells: DataFrame, path: str) -> None:
    """Version 0 of an index that takes arrivals, unless there is one."""
    spark = assigned.sparkSession
    if current(spark, path) is None:
        write_version(pivots, assigned, cells, path, 0)
        publish(spark, path, 0)


def _pending(spark: SparkSession, path: str, name: str, taken: int, upto: int | None = None) -> DataFrame:
    """(id, obj, cell, pdist) of 'admitted' or 'buffer' in the batches after ``taken``."""
    numbers = F.col("batch").cast("long")
    found = spark.read.parquet(f"{path}/{name}").where(numbers > taken)
    return (found if upto is None else found.where(numbers <= upto)).drop("batch")


def stream_compacting(stream: DataFrame, path: str, checkpoint: str, threshold: int, target_rows: int, metric: str | Metric = "l2") -> StreamingQuery:
    """Starts a query that deals arrivals to the index at ``path`` and rebuilds it whenever over ``threshold`` of them wait.

    The steps of a batch: its admitted and waiting arrivals go to folders of its
    number; if too many wait, a new version is written whole from the current one and
    all batches since; its pointer, which names the last batch it has taken in, is
    written last.  A batch that is run again after a crash overwrites what it had
    written, and does nothing once a version has taken it in.  Arrivals are placed by
    the version that is current when they come.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version, taken = current(spark, path)
        if number <= taken:
            return
        pivots, assigned, cells = read_version(spark, path, version)
        placed = stage(admit_safe(batch.select("id", "obj"), cells, pivots, metric), "arrivals")
        for name, flag in (("admitted", True), ("buffer", False)):
            placed.where(F.col("admitted") == flag).drop("admitted").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        waiting = _pending(spark, path, "buffer", taken, number)
        grown = assigned.unionByName(_pending(spark, path, "admitted", taken, number).select(*assigned.columns))
        compact(grown, waiting, threshold, target_rows, path, version + 1, metric, number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def knn_current(spark: SparkSession, path: str, queries: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """Top-k over one consistent state of an index that takes arrivals: a version and the batches after it."""
    version, taken = current(spark, path)
    _, assigned, cells = read_version(spark, path, version)
    if not exists(spark, f"{path}/buffer"):
        return knn_buffered(assigned, cells, assigned.select("id", "obj").limit(0), queries, k, metric, exclude_self)
    grown = stage(assigned.unionByName(_pending(spark, path, "admitted", taken).select(*assigned.columns)), "grown")
    return knn_buffered(grown, recount(grown, cells), _pending(spark, path, "buffer", taken).select("id", "obj"), queries, k, metric, exclude_self)
