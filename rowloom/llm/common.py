"""Helpers shared by the operators: splits, words, shared scratch tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, materialise

__all__ = ["WORD", "compact", "documents", "drop", "materialise", "shuffle_partitions", "split_of", "words"]

#: Words of the contracts; bytes.split() without an argument cuts at exactly these separators.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text, with only A-Z lower-cased; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def split_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def compact(df: DataFrame, label: str, rows_a_file: int = 100_000, codec: str = "snappy") -> DataFrame:
    """Like materialise, in as many files as the rows need instead of one for each task: the rows are
    computed once, with all tasks, into blocks on the executors' disks, counted (``n_rows``), and written from there."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        n = held.count()
        out = materialise(held.coalesce(max(1, -(-n // rows_a_file))), label, codec)
        out.n_rows = n
        return out
    finally:
        held.unpersist()
