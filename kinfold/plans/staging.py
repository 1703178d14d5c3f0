"""Cut lineage by writing tables where every executor can read them.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
local session without that setting (tests) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder shared by driver and executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-kinfold-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Whether Spark deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The folders made inside every scratch() that is open.
_open: list[list[str]] = []


def stage_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder's path in the shared folder; with ``keep`` the innermost scratch() leaves it to the one around it."""
    path = f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    if keep and len(_open) > 1:
        _open[-2].append(path)
    elif _open and not keep:
        _open[-1].append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a result is consumed more than once or an iteration must not grow
    its lineage.  The files have exact sizes, so a later join broadcasts such a
    table only when it is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return staged(spark, path, df.schema)


def staged(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at a path of stage_path(), which unstage() can delete."""
    found = spark.read.schema(schema).parquet(path)
    found.staged_path = path
    return found


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def unstage(*tables: DataFrame) -> None:
    """Deletes tables of stage() that nothing reads any more, such as an iteration's former ones."""
    for df in tables:
        if path := getattr(df, "staged_path", None):
            delete_path(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that was staged inside.

    Results are read lazily from staged tables, so write or count them inside.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete_path(spark, path)
