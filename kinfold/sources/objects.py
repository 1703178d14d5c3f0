"""Objects to search: text files of vectors, tables with a chosen type, tables of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types of object columns by their short names.
DTYPES = {"float": "array<float>", "double": "array<double>", "string": "string", "bits": "array<bigint>", "tokens": "array<string>"}


def read_vectors_text(spark: SparkSession, path: str, sep: str = " ", dtype: str = "float") -> DataFrame:
    """(id, obj) from lines of an id and its components; empty lines are skipped.

    The id is the line's first field: the order of lines means nothing in a split file.
    """
    fields = F.split(F.trim("value"), sep if len(sep) > 1 else f"[{sep}]+" if sep == " " else f"\\Q{sep}\\E")
    return (
        spark.read.text(path)
        .where(F.length(F.trim("value")) > 0)
        .select(F.element_at(fields, 1).cast("bigint").alias("id"), F.slice(fields, 2, F.size(fields) - 1).cast(DTYPES[dtype]).alias("obj"))
    )


def load_objects(df: DataFrame, id_col: str, obj_col: str, dtype: str = "double") -> DataFrame:
    """(id, obj) with the chosen type; rows whose object is null are left out (dropped_objects counts them)."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(obj_col).cast(DTYPES[dtype]).alias("obj")).where(
        F.col("obj").isNotNull()
    )


def dropped_objects(df: DataFrame, obj_col: str) -> DataFrame:
    """One row: objects and those that load_objects() leaves out."""
    return df.agg(F.count("*").alias("objects"), F.count_if(F.col(obj_col).isNull()).alias("dropped"))


def write_cells(assigned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The index table in ranges of cells, sorted by cell, so that row groups tell by their statistics which cells they hold.

    Files grow with bytes, not with cells; a cell of many objects spans several.
    """
    assigned.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.mode(mode).parquet(path)


def read_cells(spark: SparkSession, path: str, cells: list[int] | None = None) -> DataFrame:
    """The index table, or only some ``cells``, whose numbers the scan compares with the row groups' statistics."""
    found = spark.read.parquet(path)
    return found if cells is None else found.where(F.col("cell").isin(cells))
