"""Ranks and running sums of a whole table without a single-task window.

Rows fall into spans of their order key; spans are summed first, the sums run over spans, and rows
are ranked inside their span. Only one row a span meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise

SPAN = 1 << 16


def running_before(df: DataFrame, value: str, order: str, out: str, by: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """df with the sum of value over earlier rows (of the same ``by``); order: integers, distinct within ``by``."""
    rows = df.withColumn("__span", F.floor(F.col(order) / F.lit(span)).cast("long"))
    sums = rows.groupBy(*by, "__span").agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*by).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, "__span", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*by, "__span").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__span").alias("__span_"), "__start")
    on = F.col("__span") == F.col("__span_")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = rows.join(starts, on).withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.drop("__span", "__span_", "__start", *[f"__{c}" for c in by])


def rank_within(df: DataFrame, by: tuple[str, ...], order: str, out: str, span: int = SPAN) -> DataFrame:
    """0, 1, 2... by order within equal ``by``."""
    return running_before(df.withColumn("__one", F.lit(1).cast("long")), "__one", order, out, by, span).drop("__one")


def ordinals(df: DataFrame, keys: list[str], out: str = "ord", keep: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """df (of its columns those in keep) with 0..n-1 in key order, rows of equal keys in an order fixed by all their columns.

    The rows are written once, range-partitioned and sorted; a row's number is its place in its file,
    behind the rows of the files before it. Files don't change between reads, so numbers don't
    either, whatever is read of them, how reads are split, or how often tasks run again. Equal keys are spread
    over ranges by a hash of the row; only rows that are equal altogether stay together."""
    by = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    plain = [F.col(f"`{f.name}`") for f in df.schema if not _holds_map(f.dataType)]
    tie = F.xxhash64(*plain) if plain else F.lit(0).cast("long")
    spread = df.withColumn("__tie", tie).repartitionByRange(*by, F.col("__tie")).sortWithinPartitions(*by, "__tie").drop("__tie")
    held = materialise(spread if keep is None else spread.select(*keep), "ordinals", codec, maxRecordsPerFile="0")
    tagged = held.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    counts = tagged.groupBy("__file").agg(F.count("*").alias("__n"))
    # One row a file. Files are numbered as their ranges are.
    number = F.regexp_extract("__file", r"^part-(\d+)", 1).cast("long")
    before = W.orderBy(number).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("__file").alias("__f"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    named = tagged.join(F.broadcast(starts), F.col("__file") == F.col("__f"))
    return named.withColumn(out, F.col("__start") + F.col("__place")).drop("__file", "__place", "__f", "__start")


def _holds_map(kind: T.DataType) -> bool:
    """Maps (and what holds them) can't be hashed."""
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def batch_number(order: Column, size: int) -> Column:
    return F.floor(order / F.lit(size)).cast("long")
