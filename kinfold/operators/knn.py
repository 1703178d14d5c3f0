"""Exact top-k and range search, and the audit of their results.

Data is (id, obj), queries are (qid, qobj).  Results are (qid, rank, id, dist, exact).
Rows with a null id, a null object or a null number in it take no part.  A NaN or
an infinity in a vector is an ordinary number: distances that are NaN come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.metrics import METRICS, Metric, l2, metric_of, tanimoto_bits, usable
from kinfold.operators.nearest import Nearest, bit_matrix, chosen_bits, matrix, search_tiles
from kinfold.plans.pairs import BROADCAST_QUERIES, against_all
from kinfold.plans.staging import stage

#: Most numbers in the vectors that go to every task (32 MiB), and most pairs that a task keeps.
BROADCAST_NUMBERS = 4 << 20
#: Rows whose distances bound the tiles' searches from the start.
SEEDS = 4096


def top_k(distances: DataFrame, k: int, exact: bool = True) -> DataFrame:
    """The k smallest of (qid, id, dist) per query, ties to the smaller id.

    Spark limits ranks in every task before it shuffles by query.
    """
    order = W.partitionBy("qid").orderBy("dist", "id")
    return (
        distances.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("qid", "rank", "id", "dist", F.lit(exact).alias("exact"))
    )


def distances(data: DataFrame, queries: DataFrame, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """(qid, id, dist) of all pairs; those without a distance (null) are left out."""
    data, queries = usable(data, "id", "obj"), usable(queries, "qid", "qobj")
    pairs = against_all(data.select("id", "obj"), queries.select("qid", "qobj"))
    if exclude_self:
        pairs = pairs.where(F.col("id") != F.col("qid"))
    found = pairs.select("qid", "id", metric_of(metric)(F.col("obj"), F.col("qobj")).alias("dist"))
    # of these metrics none is null; a filter would make Spark compute each distance twice
    return found if metric in METRICS or metric in METRICS.values() else found.where("dist IS NOT NULL")


def l2_in_blocks(
    data: DataFrame, queries: DataFrame, k: int | None = None, radius: float = np.inf, exclude_self: bool = False, bits: bool = False
) -> DataFrame | None:
    """(qid, id, dist): each query's k nearest rows of every task, or all rows within ``radius``, by matrix products.

    None if the queries are too many or too long to send to every task; l2_in_tiles() takes those.
    With ``bits`` the same for Tanimoto distance of arrays of words.
    """
    read = bit_matrix if bits else matrix
    more = {"choose": chosen_bits} if bits else {}
    asked = usable(queries, "qid", "qobj").select("qid", "qobj")
    size = asked.agg(F.count("*"), F.sum(F.size("qobj").cast("long")), F.max(F.size("qobj"))).first()
    if not size[0] or size[0] > BROADCAST_QUERIES or size[1] > BROADCAST_NUMBERS or not size[2]:
        return None
    if k is not None and k * size[0] > BROADCAST_NUMBERS:
        return None
    found = asked.toArrow()
    width = size[2]
    table = read(found.column("qobj").combine_chunks(), width)
    shared = data.sparkSession.sparkContext.broadcast((found.column("qid").combine_chunks(), table))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, every = shared.value
        search = Nearest(qids, every, np.full(len(every), float(radius)), k, exclude_self, **more)
        for batch in batches:
            if batch.num_rows:
                search.add(read(batch.column("obj"), width), batch.column("id"))
            if k is None:
                yield from search.results()
        yield from search.results()

    kinds = [f.dataType.simpleString() for f in (asked.schema["qid"], data.schema["id"])]
    return usable(data, "id", "obj").select("id", "obj").mapInArrow(near, f"qid {kinds[0]}, id {kinds[1]}, dist double")


def l2_in_tiles(
    data: DataFrame, queries: DataFrame, k: int | None = None, radius: float = np.inf, exclude_self: bool = False
) -> DataFrame | None:
    """The same pairs for any number of queries, by tiles: blocks of queries by lanes of rows.

    A block is what a task can hold of the queries; all its lanes together see every
    row once.  Before that each block meets a bounded, hashed sample of the rows, whose
    k-th distance bounds every lane from its first row on.  Rows are shuffled once a
    block and queries once a lane, with as many tiles as there are shuffle partitions
    at least.  None without queries or with queries of no numbers.
    """
    asked = usable(queries, "qid", "qobj").select("qid", "qobj")
    rows = usable(data, "id", "obj").select("id", "obj")
    count, width = asked.agg(F.count("*"), F.max(F.size("qobj"))).first()
    if not count or not width:
        return None
    held = max(1, min(BROADCAST_QUERIES, BROADCAST_NUMBERS // max(width, k or 1)))
    blocks = -(-count // held)
    lanes = max(1, -(-int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("long")
    limits = asked.select(block.alias("block"), "qid", "qobj", F.lit(float(radius)).alias("radius"))
    if k is not None:
        few = rows.orderBy(F.xxhash64("id"), "id").limit(max(SEEDS, 4 * k))
        seen = search_tiles(few.select(each(blocks).alias("tile"), "id", "obj"), limits.withColumnRenamed("block", "tile"), k, exclude_self)
        kth = top_k(seen, k).where((F.col("rank") == k) & ~F.isnan("dist")).select("qid", F.col("dist").alias("near")).distinct()
        limits = limits.join(stage(kth, "bounds"), "qid", "left").select(
            "block", "qid", "qobj", F.least("radius", F.coalesce(F.col("near") * (1 + 1e-9), F.lit(np.inf))).alias("radius")
        )
    tile = lambda b, lane: (b * lanes + lane).cast("long").alias("tile")
    asked = limits.withColumn("lane", each(lanes)).select(tile(F.col("block"), F.col("lane")), "qid", "qobj", "radius")
    dealt = rows.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes))).withColumn("block", each(blocks))
    return search_tiles(dealt.select(tile(F.col("block"), F.col("lane")), "id", "obj"), asked, k, exclude_self)


def _bits_in_blocks(data: DataFrame, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame | None:
    """(qid, id, dist) under Tanimoto distance of words, as l2_in_blocks() finds it; more queries than a task holds go block by block. None where there is nothing to ask."""
    count, width = usable(queries, "qid", "qobj").agg(F.count("*"), F.max(F.size("qobj"))).first()
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((data, "obj"), (queries, "qobj"))]
    if not count or not width or kinds != ["array<bigint>"] * 2:
        return None
    blocks = -(-2 * count // min(BROADCAST_QUERIES, BROADCAST_NUMBERS // max(k, 64 * width)))
    block, found = F.pmod(F.xxhash64("qid"), F.lit(blocks)), None
    for b in range(blocks):
        part = l2_in_blocks(data, queries.where(block == b), k, exclude_self=exclude_self, bits=True)
        if part is None and queries.where(block == b).isEmpty():
            continue
        if part is None:  # one id's queries alone are too many
            return None
        found = part if found is None else found.unionByName(part)
    return found


def _l2(data: DataFrame, queries: DataFrame, metric: str | Metric, k: int | None, radius: float, exclude_self: bool) -> DataFrame | None:
    """(qid, id, dist) by matrix products; None for other metrics, or where there is nothing to ask."""
    if metric not in ("l2", l2):
        return None
    found = l2_in_blocks(data, queries, k, radius, exclude_self)
    return l2_in_tiles(data, queries, k, radius, exclude_self) if found is None else found


def knn_exact(data: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """Brute-force top-k.  Queries need not come from the data; k beyond the data gives all rows.

    Euclidean and bits' Tanimoto distance go by matrix products over batches of rows, with queries sent
    to every task or, beyond what a task holds, dealt in tiles; any other metric by
    pairs of rows.
    """
    if metric in ("tanimoto_bits", tanimoto_bits):
        blocks = _bits_in_blocks(data, queries, k, exclude_self)
    else:
        blocks = _l2(data, queries, metric, k, np.inf, exclude_self)
    return top_k(distances(data, queries, metric, exclude_self) if blocks is None else blocks, k)


def range_search(data: DataFrame, queries: DataFrame, radius: float, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """(qid, id, dist) within ``radius``, its border included."""
    blocks = _l2(data, queries, metric, None, radius, exclude_self)
    found = distances(data, queries, metric, exclude_self) if blocks is None else blocks
    return found.where((F.col("dist") <= radius) & ~F.isnan("dist"))


def check_topk(result: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """(qid, rows, bad_dists, bad_ranks, valid): one row a query, those without a result too.

    A result is valid with min(n, k) rows, ranks 1, 2, ... in order of (dist, id), and
    distances that are numbers from 0 up.
    """
    order = W.partitionBy("qid").orderBy("dist", "id")
    ranked = result.withColumn("__want", F.row_number().over(order))
    per_query = ranked.groupBy("qid").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("dist").isNull() | F.isnan("dist") | (F.col("dist") < 0)).alias("bad_dists"),
        F.count_if(F.col("rank") != F.col("__want")).alias("bad_ranks"),
    )
    zero = F.lit(0).cast("long")
    return (
        queries.select("qid").join(per_query, "qid", "left")
        .select("qid", *[F.coalesce(c, zero).alias(c) for c in ("rows", "bad_dists", "bad_ranks")])
        .withColumn("valid", (F.col("rows") == min(n, k)) & (F.col("bad_dists") == 0) & (F.col("bad_ranks") == 0))
    )


def require_valid(result: DataFrame, queries: DataFrame, n: int, k: int) -> None:
    """Raises if any query's result is not valid."""
    bad = check_topk(result, queries, n, k).where("NOT valid").limit(5).collect()
    if bad:
        raise ValueError(f"top-k results are not valid, such as {bad}")
