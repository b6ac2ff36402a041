"""Results computed once, on storage that outlives any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may go without the setting; it gets a temporary
    folder that is removed at exit. On a cluster a missing one is an error.
    """
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="scriptorium-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; it goes with the application."""
    top = f"{folder(spark)}/scriptorium-{spark.sparkContext.applicationId}"
    at, fs = _at(spark, top)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{top}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder and read back; it goes with the application, or by ``drop``."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Remove the files of ``cut`` frames that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            at, fs = _at(df.sparkSession, file)
            fs.delete(at.getParent(), True)
