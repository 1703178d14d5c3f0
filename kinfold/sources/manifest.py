"""Manifests of items with hashes, and exact bytes of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stated, as inference would read the map as a struct of all keys it met.
MANIFEST = (
    "snapshot_date string, "
    "items array<struct<item_id: string, source_sha256: string, payload_sha256: string, binaries: map<string,string>>>, "
    "excluded array<struct<item_id: string, reason: string>>"
)


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=not lines).withColumn(
        "snapshot_date", F.to_date("snapshot_date")
    )


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(snapshot_date, item_id, source_sha256, payload_sha256, binaries): one row an item.

    A file is one document, or with ``lines`` one document a line, which Spark can split.
    """
    return _documents(spark, path, lines).select("snapshot_date", F.inline("items"))


def read_exclusions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(snapshot_date, item_id, reason): one row an item left out."""
    return _documents(spark, path, lines).select("snapshot_date", F.inline("excluded"))


def binaries(items: DataFrame) -> DataFrame:
    """(item_id, payload_sha256, binary, binary_sha256): one row a map entry; items without any keep one row."""
    return items.select(
        "item_id", "payload_sha256", F.explode_outer("binaries").alias("binary", "binary_sha256")
    )


def hash_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(glob).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
