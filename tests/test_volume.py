"""How much is written, moved and held by tasks, whatever the number of rows."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rowloom.operators import cardinality, generate
from rowloom.plans import registry
from rowloom.schema import Column, Kind, Table
from rowloom.scratch import folder
from rowloom.sinks import sqltext


def written(spark, before=()):
    """Tables in the scratch folder: name and rows."""
    found = [d for d in Path(folder(spark)).iterdir() if d.is_dir() and d not in before]
    return {d: sum(pq.ParquetFile(f).metadata.num_rows for f in d.glob("*.parquet")) for d in found}


def test_children_are_neither_written_nor_moved(spark, capsys):
    parents = spark.range(300).select((F.col("id") * 3).alias("ord"), F.col("id").alias("parent"), (F.col("id") % 100).alias("n_children"))
    before = set(written(spark))
    each = cardinality.expand(parents, 1, "t", "c", ["parent"])
    assert sum(written(spark, before).values()) == 297
    each.explain()
    assert "Exchange" not in capsys.readouterr().out
    n = 3 * 99 * 50
    got = each.collect()
    assert sorted(r["child_ord"] for r in got) == list(range(n))
    assert {r["parent"]: r["count"] for r in each.groupBy("parent").count().collect()} == {i: i % 100 for i in range(300) if i % 100}
    of = [r["child_ord"] for r in got if r["parent"] == 99]
    assert len({b - a for a, b in zip(of, of[1:])}) > 20 and max(of) - min(of) > n / 2
    assert cardinality.expand(parents.where("n_children = 0"), 1, "t", "c", ["parent"]).count() == 0


def test_a_stream_has_as_many_files_as_its_rows_need(spark, monkeypatch):
    monkeypatch.setattr(registry, "STREAMED", 100)
    t = Table("flags", (Column("id", Kind.BIGINT, nullable=False, auto_increment=True),), ("id",))
    before = set(written(spark))
    made = registry.streamed(spark, t, generate.Config(1), 1050)
    assert sorted(r["id"] for r in made.collect()) == list(range(1, 1051))
    (numbers,) = [d for d in written(spark, before) if d.name.startswith("numbers-") and not d.name.endswith(("-streamed", "-checkpoint"))]
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in numbers.glob("*.parquet")]
    assert len(sizes) == 11 and max(sizes) <= 100
    assert len(list(Path(f"{numbers}-streamed-checkpoint", "commits").glob("[0-9]*"))) == 2


def test_statements_write_each_row_once_as_text(spark):
    rows = spark.range(2000).select("id", (F.col("id") * 7).alias("other"), F.lit("x").alias("note"))
    before = set(written(spark))
    made = sqltext.insert_statements(rows, "t", rows.columns, ["id", "other"], 500)
    ((numbered, n),) = written(spark, before).items()
    assert n == 2000
    files = [pq.ParquetFile(f) for f in numbered.glob("*.parquet")]
    assert {tuple(f.schema_arrow.names) for f in files} == {("__v",)}
    got = {r["batch"]: r["statement"] for r in made.collect()}
    head = 'INSERT INTO "t" ("id", "other", "note") VALUES '
    assert got == {b: head + ", ".join(f"({i}, {7 * i}, 'x')" for i in range(500 * b, 500 * b + 500)) + ";" for b in range(4)}
