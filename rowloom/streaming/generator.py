"""Rows as a stream: values are functions of the row number, so a stream needs no state.

A stream has what a batch has: references (arithmetic, or one join with the parents' keys, which stay as they are
while it runs), NULLs, groups, overrides, text pools, and keys of known domains that are unique by
construction. Row i equals row i of the batch, but for columns that are unique by themselves or in a key with
a free column: a batch tells equal values apart by their rank, a stream by the row number in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GenerationFailed
from ..operators.generate import Config, Generator, insertable, parent_ordinal
from ..schema import Schema, Table, ancestors


def stream_table(spark: SparkSession, table: Table, config: Config, rows_per_second: int = 100, schema: Schema | None = None, existing: dict[str, DataFrame] | None = None) -> DataFrame:
    """An unbounded stream of rows of one table, with its event time. It ends at the configured number of rows
    where that bounds the table: unique keys of known domains, cardinalities, trees."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return project(source.select(F.col("value").alias("__row"), F.col("timestamp").alias("event_time")), table, config, schema, existing)


def project(df: DataFrame, table: Table, config: Config, schema: Schema | None = None, existing: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of a table for the numbers in ``__row``, a stream or not; ``event_time`` stays. schema: where its
    references point; parents without existing rows are those that the same configuration makes."""
    schema = schema or Schema.of(table)
    key = schema.resolve(table.full_name)
    maker = Generator(df.sparkSession, schema, config, existing)
    above = ancestors(schema, [key]) - {key}
    for name in maker.plan.ordered:
        if name in above and maker.existing.get(name) is None:
            maker.out.tables[name] = maker.fill_self(name, maker.table(name))
            maker.out.counts[name] = config.count(name)
    t, n = schema.tables[key], config.count(key)
    later = {e.key for e in maker.plan.deferred if e.child == key}
    _, placed = maker.place_keys(maker.spark.range(0).select(F.col("id").alias("__row")), t, later, n) if n else (None, set())
    if placed or maker.plan.self_references.get(key) or config.cardinality.get(key, config.cardinality.get(t.name)):
        df = df.where(F.col("__row") < n)
    made = maker.table(key, df)
    for e in maker.plan.self_references.get(key, []):
        if e.key.references != t.primary_key or not t.column(t.primary_key[0]).auto_increment:
            raise GenerationFailed(f"a stream of {key} can't refer to its own rows by {','.join(e.key.references)}", hints=("only keys that count up are known beforehand",))
    made = maker.fill_self(key, made)
    for e in maker.plan.deferred:
        if e.child == key:
            pool = maker.pool(e.parent, e.key.references)
            if pool.size:
                made = maker.attach(made.drop(*e.key.columns), pool, parent_ordinal(config.seed, key, e.key.columns, F.col("__row"), pool.size), e.key)
    first = ["event_time"] if "event_time" in df.columns else []
    return made.select(*first, *[F.col(c).cast(t.column(c).spark_type()).alias(c) for c in insertable(t)])


def write_stream(rows: DataFrame, path: str, checkpoint: str, form: str = "parquet", **trigger) -> None:
    """Run a stream into a folder until it has taken all that is there (trigger availableNow by default);
    with its checkpoint, a run that was stopped goes on where it was, and writes each row once."""
    rows.writeStream.format(form).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path).awaitTermination()


def unique_within(df: DataFrame, column: str, delay: str = "10 minutes") -> DataFrame:
    """Uniqueness needs state; it is bounded by the watermark."""
    return df.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([column])
