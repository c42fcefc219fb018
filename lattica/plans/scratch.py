"""Intermediate tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEARED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set as the session's checkpoint folder.

    Where neither is set, a local master gets a temporary folder; any other master is an
    error, as each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lattica-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """Where this application's tables lie; clear() removes it."""
    return f"{shared_folder(spark)}/lattica-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear_at_exit(spark: SparkSession, folder: str) -> None:
    """Has the driver's file system remove the application's tables when it closes, at the end of the driver."""
    if folder not in _CLEARED:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        _CLEARED.add(folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    folder = session_folder(df.sparkSession)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _clear_at_exit(df.sparkSession, folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else it is left to a shuffle join. df is materialised or cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


def forget(df: DataFrame) -> None:
    """Removes the table of a materialize() that no plan will read again, as the last round of an iteration."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lattica-" in path:
            _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Removes all tables of this application now, when no result is read any more; else this happens when the driver ends."""
    _remove(spark, session_folder(spark))
