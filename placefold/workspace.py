"""Shared folders for written intermediates (stream state, checkpoints).

The cluster names a folder that every executor can reach in
``spark.checkpoint.dir``. Only a local-mode session that names none gets a
folder of this machine, so that tests run without configuration.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="placefold-")


def shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _local_root()
    raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A path nobody has used yet; Spark creates it on first write."""
    return f"{shared_root(spark)}/placefold/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table of the shared folder, for steps that read it more than once."""
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_dir`` named, once nothing reads it any more."""
    fs, target = _located(spark, path)
    fs.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isFile()


def child_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``; empty if it is missing."""
    fs, target = _located(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory())
