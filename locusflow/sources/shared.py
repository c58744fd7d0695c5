"""Folders that driver and executors share, and tables written there to cut a plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``; only a local run may do without."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not top and "cluster" not in spark.sparkContext.master and spark.sparkContext.master.startswith("local"):
        top = tempfile.mkdtemp(prefix="locusflow-")
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session may have ended
        remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a shared folder, which goes when the driver ends or ``remove`` takes it.

    What is read from it costs no earlier work if an executor is lost, and joins know its size.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path)
