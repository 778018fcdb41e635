"""Scratch tables in the folder that all executors share.

A written table cuts lineage, survives lost executors and is the same however often it is read. All of
an application's tables lie in one folder, which goes when the application ends; ``drop`` lets a
table go as soon as nothing reads it any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import MissingTarget


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or None
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise MissingTarget("spark.checkpoint.dir isn't set", hints=("name a folder that the driver and all executors share",))
        found = tempfile.mkdtemp(prefix="rowloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """This application's own folder, deleted when its JVM ends."""
    root = f"{shared_dir(spark)}/rowloom-{spark.sparkContext.applicationId}"
    p, fs = _path(spark, root)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return root


def materialise(df: DataFrame, label: str, codec: str = "snappy", **options) -> DataFrame:
    """Write a table into the application's folder and read it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; others are left alone."""
    for t in tables:
        path = t.__dict__.get("scratch_path")
        if path:
            p, fs = _path(t.sparkSession, path)
            fs.delete(p, True)

