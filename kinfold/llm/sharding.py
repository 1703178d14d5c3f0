"""Sharding by global byte-size prefix sums.

Documents are range-partitioned by (text digest, id), so that equal texts are
neighbours.  Per-partition totals give each partition its place in one global
line of bytes; the line is cut at equal targets into contiguous shards.  A cut
that falls inside a small group of equal texts moves to the group's nearer end;
a group larger than ``snap`` of a shard is cut by rows, as it can't stay whole in
shards of near equal size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.plans.staging import stage


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    snap: float = 0.01,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``.

    Size: UTF-8 bytes of the text plus 1.  Slots run from 0 without gaps in each
    shard.  Defined cases: null text has no bytes and crc32 0 and groups with the
    empty text; null ids and repeated rows are placed like others; shards stay
    empty if there are too few rows; an empty table gives an empty table.

    The text stays in the scan: what is shuffled, once by range, are the
    id, size and digests.  The sums use one row per partition, and the cuts are
    ``n_shards - 1`` numbers, the only thing that the driver sees.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text) + 1).cast("long").alias("__size"),
        F.crc32(text).alias("__crc"),
        F.md5(text).alias("__order"),
    )
    # range partitioning samples its input, so what it made is written before it is used twice
    placed = stage(
        slim.repartitionByRange("__order", "__id").withColumn("__part", F.spark_partition_id()), "ranges"
    )
    totals = placed.groupBy("__part").agg(F.sum("__size").alias("__psize"), F.count("*").alias("__prows"))
    line = W.orderBy("__part")
    starts = totals.select(
        F.col("__part").alias("__p"),
        (F.sum("__psize").over(line) - F.col("__psize")).alias("__pstart"),
        (F.sum("__prows").over(line) - F.col("__prows")).alias("__prank"),
    )
    within = W.partitionBy("__part").orderBy("__order", "__id", "__size")
    upto = within.rowsBetween(W.unboundedPreceding, 0)
    rows = stage(
        placed.withColumn("__run", F.sum("__size").over(upto))
        .withColumn("__row", F.row_number().over(within))
        .join(starts, F.col("__part") == F.col("__p"))
        .select(
            "__id",
            "__size",
            "__crc",
            "__order",
            (F.col("__pstart") + F.col("__run") - F.col("__size")).alias("__start"),
            (F.col("__prank") + F.col("__row") - 1).alias("__rank"),
        ),
        "line",
    )
    cuts = _cuts(rows, n_shards, snap)
    shard = reduce(lambda a, c: a + (F.col("__start") >= F.lit(c)).cast("int"), cuts, F.lit(0))
    sharded = rows.withColumn("__shard", shard)
    first = sharded.groupBy("__shard").agg(F.min("__rank").alias("__first"))
    first = first.withColumnRenamed("__shard", "__s")
    return sharded.join(F.broadcast(first), F.col("__shard") == F.col("__s")).select(  # n_shards rows
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        (F.col("__rank") - F.col("__first")).alias("slot"),
    )


def _cuts(rows: DataFrame, n_shards: int, snap: float) -> list[int]:
    """Start offsets of shards 1 and up: equal targets, moved to row or group borders.

    Collects the rows at the targets and the extents of their groups: at most
    ``n_shards - 1`` of either.
    """
    end = F.col("__start") + F.col("__size")
    total = rows.agg(F.max(end)).first()[0] or 0
    targets = [total * k // n_shards for k in range(1, n_shards)]
    at = reduce(lambda a, c: a | ((F.col("__start") <= c) & (end > c)), targets, F.lit(False))
    hit = rows.where(at).select("__order", "__start", end.alias("__end")).collect()
    groups = {
        g["__order"]: (g["lo"], g["hi"])
        for g in rows.where(F.col("__order").isin(sorted({r["__order"] for r in hit})))
        .groupBy("__order")
        .agg(F.min("__start").alias("lo"), F.max(end).alias("hi"))
        .collect()
    }
    cuts = []
    for c in targets if total else []:
        row = next(r for r in hit if r["__start"] <= c < r["__end"])
        lo, hi = groups[row["__order"]]
        if hi - lo > snap * total / n_shards:  # too large to stay whole: cut between rows
            lo, hi = row["__start"], row["__end"]
        cuts.append(lo if c - lo <= hi - c else hi)
    return cuts
