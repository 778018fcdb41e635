"""Folders of any file system that Spark can reach: what is there, moving into place, deleting what one has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import OutputFailed


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without hidden ones and markers; none where it isn't there."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n[:1] not in "._")


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; never onto something that is there."""
    a, fs = _at(spark, source)
    b, _ = _at(spark, target)
    if fs.exists(b) or not fs.rename(a, b):
        raise OutputFailed(f"{source} can't be moved to {target}")


def make(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.mkdirs(p)


def staging(path: str) -> str:
    """A hidden folder beside the results: readers of ``path`` don't see it."""
    return f"{path}/_rowloom-{uuid.uuid4().hex}"


def add(df: DataFrame, path: str, form: str = "parquet") -> list[str]:
    """Append df to a folder, and say which files it came to: written aside, then moved in under names of their own.
    When a move fails, those made before are taken back."""
    spark, aside = df.sparkSession, staging(path)
    mark, moved = uuid.uuid4().hex[:12], []
    try:
        df.write.format(form).save(aside)
        for n in names(spark, aside):
            target = f"{path}/rowloom-{mark}-{n}"
            move(spark, f"{aside}/{n}", target)
            moved.append(target)
    except Exception:
        for f in moved:
            delete(spark, f)
        raise
    finally:
        delete(spark, aside)
    return moved


def delete_files(spark: SparkSession, files: list[str]) -> None:
    """Delete these files, and each folder that then holds nothing."""
    for f in files:
        delete(spark, f)
    for folder in dict.fromkeys(f.rsplit("/", 1)[0] for f in files):
        if not names(spark, folder):
            delete(spark, folder)
