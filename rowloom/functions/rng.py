"""Random numbers as pure functions of seed, table, column, row and draw.

Output so depends on neither partitions nor order nor retries, and another engine can compute the
same values. All are Column expressions inside code generation; nothing is stateful.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, table: str, column: str, row: Column, draw: int | Column = 0) -> Column:
    """[0, 1): the first 32 bits of an md5 as a fraction."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(table), F.lit(column), row.cast("string"), (F.lit(draw) if isinstance(draw, int) else draw).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sql_uniform(seed: int, table: str, column: str, row: str, draw: int | str = 0) -> str:
    """The same in SQL of an engine that reads hexadecimal text as a number."""
    return f"(('0x' || substr(md5('{seed}|{table}|{column}|' || ({row})::VARCHAR || '|{draw}'), 1, 8))::BIGINT / 4294967296.0)"


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def pick(u: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * F.lit(len(values))) + 1).cast("int"))


def between(u: Column, low: int, high: int) -> Column:
    """Integers low..high."""
    return (F.floor(u * F.lit(high - low + 1)) + F.lit(low)).cast("long")


def weighted(u: Column, values: list, weights: list[float]) -> Column:
    total, at = sum(weights), 0.0
    out = None
    for v, w in zip(values[:-1], weights[:-1], strict=True):
        at += w / total
        out = F.when(u < at, F.lit(v)) if out is None else out.when(u < at, F.lit(v))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def cyclic(row: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(row, F.lit(len(values))) + 1).cast("int"))


def spread(row: Column) -> Column:
    """A fixed spread of row numbers over thousandths, by a multiplicative hash."""
    return F.pmod(row * F.lit(2654435761), F.lit(1000)) / F.lit(1000.0)


def normal(u1: Column, u2: Column, mean: float = 0.5, deviation: float = 0.15) -> Column:
    z = F.sqrt(F.lit(-2.0) * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * u2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(mean) + F.lit(deviation) * z))


def exponential(u: Column, rate: float = 1.0) -> Column:
    """A truly exponential density on [0, 1], cut at 1 and normalised."""
    return -F.log(F.lit(1.0) - u * F.lit(1.0 - math.exp(-rate))) / F.lit(rate)


def zipf_table(spark: SparkSession, ranks: int, exponent: float = 1.0) -> DataFrame:
    """rank, low, high: the cumulative shares of 1/rank**s, once for each (ranks, s). Prefix sums run in blocks of ranks and
    over the blocks' sums, so any number of ranks will do."""
    from ..operators.prefix import running_before

    base = spark.range(1, ranks + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-float(exponent))).alias("p"))
    total = base.agg(F.sum("p")).first()[0]
    summed = running_before(base, "p", "rank", "__before")
    return summed.select("rank", (F.col("__before") / F.lit(total)).alias("low"), ((F.col("__before") + F.col("p")) / F.lit(total)).alias("high"))


#: Spans of the draws in which ranks are looked up.
ZIPF_SPANS = 1 << 12


def zipf_draws(df: DataFrame, u: str, ranks: int, exponent: float = 1.0, out: str = "rank") -> DataFrame:
    """df with the rank in 1..ranks that a uniform draw in column u falls to, by the exact cumulative shares: an as-of
    lookup in their table, for any number of ranks and draws."""
    from ..operators.asof import as_of

    starts = zipf_table(df.sparkSession, ranks, exponent).select(F.col("low").alias(u), F.col("rank").alias("__rank"))
    return as_of(df, starts, u, "__rank", out, lambda at: F.floor(at * F.lit(ZIPF_SPANS)))


def zipf_rank(u: Column, ranks: int, exponent: float = 1.0) -> Column:
    """Rank in 1..ranks by inverting the continuous power law: constant work a draw, no table, for any
    number of ranks; its shares are within a rank's width of the discrete ones."""
    n = float(ranks)
    if abs(exponent - 1.0) < 1e-9:
        x = F.exp(u * F.lit(math.log(n + 1)))
    else:
        e = 1.0 - exponent
        x = F.pow(u * F.lit((n + 1) ** e - 1) + F.lit(1.0), F.lit(1.0 / e))
    return F.least(F.lit(ranks), F.greatest(F.lit(1), F.floor(x))).cast("long")


def share(kind: str, seed: int, table: str, column: str, row: Column, total: int, **options) -> Column:
    """A number in [0, 1] of the named distribution; unknown names are uniform."""
    u = uniform(seed, table, column, row, 0)
    if kind == "normal":
        return normal(u, uniform(seed, table, column, row, 1), options.get("mean", 0.5), options.get("deviation", 0.15))
    if kind == "exponential":
        return exponential(u, options.get("rate", 1.0))
    if kind == "zipf":
        n = max(total, 100)
        return (zipf_rank(u, n, options.get("exponent", 1.0)) - 1) / F.lit(float(n - 1))
    return u


DISTRIBUTIONS = ("uniform", "normal", "zipf", "exponential")


def is_distribution(name: str) -> bool:
    return name in DISTRIBUTIONS
