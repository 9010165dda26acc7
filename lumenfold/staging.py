"""Tables written once, so that a lost executor costs a reread and never other rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is
    unset, one of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lumenfold-tables-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back. What dropped() doesn't delete before is deleted
    when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _path(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenfold_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of staged() that no later step reads; another frame is left alone."""
    path = getattr(df, "_lumenfold_path", None)
    if path is not None:
        target, files = _path(df.sparkSession, path)
        files.delete(target, True)
        files.cancelDeleteOnExit(target)
