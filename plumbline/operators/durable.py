"""Materialised intermediate results that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="plumbline-")
    return _local_dir


def _at(spark: SparkSession, path: str) -> tuple:
    """The folder's file system and Hadoop path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def stage_path(spark: SparkSession, kind: str = "stage") -> str:
    """A new folder name in the shared folder; what is there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    system, hadoop = _at(spark, path)
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stage folder that nothing reads any more."""
    system, hadoop = _at(spark, path)
    system.delete(hadoop, True)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet to `path`, a new stage folder by default, and read it back.

    The folder stays until the driver ends, or until `discard` is called with its path.
    """
    spark = df.sparkSession
    path = path or stage_path(spark)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
