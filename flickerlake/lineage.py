"""Cutting lineage with tables in the folder that all executors share.

An application's scratch tables lie in one folder of its own, which goes when its JVM ends; tables that
are superseded earlier are discarded at once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session may go without and gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="flickerlake-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, label: str) -> str:
    own = f"{shared_dir(spark)}/flickerlake/{spark.sparkContext.applicationId}"
    store, target = _file_system(spark, own)
    if not store.exists(target):
        store.mkdirs(target)
        store.deleteOnExit(target)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and nothing reads any more; others are left alone."""
    for table in tables:
        if path := table.__dict__.get("scratch"):
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the file system that holds it."""
    store, target = _file_system(spark, path)
    store.delete(target, True)
