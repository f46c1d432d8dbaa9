"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one will do for a local
    master only (one machine); anywhere else the machines would not see each other's tables."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="veriscreen-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, by Spark's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def replaced(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to target, in place of what is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(hadoop(target), True)
    if not files.rename(hadoop(source), hadoop(target)):
        raise OSError(f"{source} could not be moved to {target}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver's Python ends, if the session still runs then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                drop(spark, path)

    atexit.register(gone)
    return path


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that what builds on them several times reads them and not their
    sources; survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
