"""A query set against all rows, in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: Queries that go to every task at once, and their bytes; more of them are dealt in blocks.
BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 64 << 20
BLOCK_QUERIES = 5_000


def _bytes(value: Column, kind: DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, (StringType, BinaryType, ArrayType)):
        size = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(_bytes(x, kind.elementType), F.lit(0)))
    elif isinstance(kind, ArrayType):
        size = 8 * F.size(value)
    else:
        size = F.lit(0)
    return F.coalesce(size.cast("long"), F.lit(0)) + 8


def _measured(t: DataFrame) -> tuple[int, int]:
    """The number of rows, and about their bytes."""
    own = [_bytes(F.col(f.name), f.dataType) for f in t.schema]
    return tuple(t.agg(F.count("*"), F.coalesce(F.sum(sum(own[1:], own[0])), F.lit(0))).first())


def against_all(
    data: DataFrame, queries: DataFrame, most: int = BROADCAST_QUERIES, block: int = BLOCK_QUERIES, most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every row of ``data`` with every row of ``queries``.

    Up to ``most`` queries of ``most_bytes``, measured first, are broadcast and
    ``data`` stays where it is; of more queries and as few rows of ``data``, such as
    cells, these are.  Beyond that blocks of queries meet slices of the data in an
    equi-join, so that memory stays bounded whichever side grows.
    """
    n, size = _measured(queries)
    if n <= most and size <= most_bytes:
        return data.crossJoin(F.broadcast(queries))
    rows, held = _measured(data)
    slices = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows <= most and held <= most_bytes:
        return queries.repartition(slices).crossJoin(F.broadcast(data)).select(*data.columns, *queries.columns)
    blocks = max(-(-n // block), -(-4 * size // most_bytes))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = data.withColumn("__slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("__block", each(blocks))
    right = queries.withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("__slice", each(slices))
    return left.join(right, ["__slice", "__block"]).drop("__slice", "__block")
