"""Steps that several statements read, kept as tables in the folder that the cluster shares.

A kept step is scanned, not planned again: the statements over it stay small, and a lost executor loses nothing. The
folder is the one that the session names in spark.checkpoint.dir, on whatever file system that path belongs to; a path
without a scheme belongs to the default one. Folders are deleted when the driver's JVM ends, or before by `drop`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A new folder, as a full URI, below spark.checkpoint.dir; a temporary one only in local mode, where nothing set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="barline-")
    path, files = _path(spark, f"{base.rstrip('/')}/barline-{uuid.uuid4().hex}")
    files.mkdirs(path)
    files.deleteOnExit(path)
    uri = files.makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut and lost executors don't lose it."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own and read again."""
    return written(df, shared_folder(df.sparkSession), name)
