"""Where files go that driver and executors share, and how tasks open them."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on one machine (tests), a folder of our own; a cluster without one is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="panelyard-")
        sc.setCheckpointDir(named)
    return qualified(spark, named).rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's path and its file system, by the session's settings."""
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    return whole, whole.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Hadoop's settings give it."""
    whole, store = hadoop_path(spark, path)
    found = store.makeQualified(whole).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own within the application's part of the shared one."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/panelyard/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; no result that reads from it may be used after that."""
    delete_folder(spark, _own_dir(spark))


def as_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later reads repeat no work and survive lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    whole, store = hadoop_path(spark, folder)
    store.delete(whole, True)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and the path in it, for a path with a scheme."""
    if "://" not in path:
        raise ValueError(f"a path needs a scheme: {path}")
    return fs.FileSystem.from_uri(path)
