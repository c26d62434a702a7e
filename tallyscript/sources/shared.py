"""The folder that the driver and all executors share, for what is written once and read again."""

from __future__ import annotations

import atexit
import urllib.parse
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine may name none and gets its warehouse's, a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def at(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/"))
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session still runs."""
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, for plans that read it several times."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
