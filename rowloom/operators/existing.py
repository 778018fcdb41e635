"""What existing tables hold: counts, keys, distinct values - full scans with partial aggregation, no samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Kind, Table


@dataclass
class Existing:
    rows: int = 0
    frame: DataFrame | None = None
    next_key: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()


def read_existing(table: Table, df: DataFrame | None) -> Existing:
    """A failing query becomes a warning and counts as no data, like a table that isn't there."""
    out = Existing(frame=df)
    if df is None:
        return out
    auto = [c.name for c in table.columns if c.name in df.columns and (c.auto_increment or c.name in table.primary_key) and c.kind in (Kind.SMALLINT, Kind.INTEGER, Kind.BIGINT)]
    try:
        got = df.agg(F.count("*").alias("n"), *[F.max(c).alias(f"m_{c}") for c in auto]).first()
        out.rows = got["n"]
        out.next_key = {c: got[f"m_{c}"] + 1 for c in auto if got[f"m_{c}"] is not None}
    except Exception as e:  # any source may fail to be read
        out.frame, out.rows = None, 0
        out.warnings.append(f"existing rows of {table.full_name} can't be read: {e}")
    return out
