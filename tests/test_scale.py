"""What goes wrong only with many or wide rows: numbering, batches, expansion."""

import pytest
from pyspark.sql import functions as F

from rowloom import api
from rowloom.operators import cardinality
from rowloom.operators.prefix import ordinals
from rowloom.schema import Column, Kind, Schema, Table
from rowloom.sinks import sqltext

KEY = Column("id", Kind.INTEGER, nullable=False, auto_increment=True)


@pytest.fixture
def many(spark):
    """64 shuffle partitions that adaptive execution may merge."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def dense(df, column, n):
    got = df.agg(F.count("*"), F.min(column), F.max(column), F.countDistinct(column)).first()
    return tuple(got) == (n, 0, n - 1, n)


def test_ordinals_of_a_million_wide_rows(many):
    n = 1_000_000
    wide = many.range(n).select((F.col("id") * 7919 % n).alias("id"), F.repeat(F.md5(F.col("id").cast("string")), 5).alias("pad"))
    got = ordinals(wide, ["id"])
    assert dense(got, "ord", n) and got.where("ord <> id").isEmpty() and got.where(F.length("pad") != 160).isEmpty()


def test_ordinals_of_equal_keys(many):
    got = ordinals(many.range(300_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("k")).alias("k"), "id"), ["k"])
    assert dense(got, "ord", 300_000) and got.where("k is null").agg(F.max("ord")).first()[0] == 99_999
    assert dense(ordinals(many.range(1000).select(F.lit(1).alias("k")), ["k"]), "ord", 1000) and ordinals(many.range(0), ["id"]).count() == 0


def test_statements_hold_all_rows(many, tmp_path):
    wide = many.range(200_000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 5).alias("pad"))
    got = sqltext.insert_statements(wide, "t", ["id", "pad"], ["id"]).select("batch", F.size(F.split("statement", r"\), \(")).alias("n"), F.regexp_extract("statement", r"VALUES \((\d+)", 1).cast("long").alias("first"))
    assert got.count() == 400 and got.where("n <> 500 or first <> batch * 500").isEmpty()
    s = Schema.of(Table("t", (KEY, Column("note", Kind.TEXT, nullable=False)), ("id",)))
    api.seed(many, s, count=200_000, path=str(tmp_path / "sql"), form="sql")
    text = [x for f in sorted((tmp_path / "sql" / "0000_t").glob("*.txt")) for x in f.read_text().splitlines()]
    assert sum(x.startswith("INSERT") for x in text) == 400 and sum(x.count("), (") + 1 for x in text if x.startswith("INSERT")) == 200_000
    assert text[:2] == ["-- t", "BEGIN;"] and text[-2].startswith("SELECT setval") and text[-1] == "COMMIT;"


def test_expansion_of_two_million_children(many):
    parents = many.range(1000).select(F.col("id").alias("ord"), F.col("id").alias("parent"), F.lit(2000).alias("n_children"))
    each = cardinality.expand(parents, 1, "t", "c", ["parent"])
    assert dense(each, "child_ord", 2_000_000)
    assert each.groupBy("parent").count().where("count <> 2000").isEmpty()
