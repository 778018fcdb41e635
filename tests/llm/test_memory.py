"""What tasks hold at once, whatever their input."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rowloom.llm import alignment, hyperminhash, packing
from rowloom.scratch import folder


def files_of(spark, label, before):
    return [f for d in Path(folder(spark)).glob(f"{label}-*") if d not in before for f in d.glob("*.parquet")]


def folders(spark, label):
    return set(Path(folder(spark)).glob(f"{label}-*"))


def test_aligned_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 4096)
    docs = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.md5((F.col("id") * 31 + i).cast("string")) for i in range(10)]).alias("text"))
    before = folders(spark, "aligned")
    want = {tuple(r) for r in alignment.align(docs).collect()}
    (whole,) = files_of(spark, "aligned", before)
    rows = pq.ParquetFile(whole).metadata
    assert rows.num_rows > 40  # of which the default writer would hold 100 before it looks at their size
    monkeypatch.setitem(alignment.ROW_GROUPS, "parquet.block.size", 1 << 16)
    before = folders(spark, "aligned")
    assert {tuple(r) for r in alignment.align(docs).collect()} == want
    (cut,) = files_of(spark, "aligned", before)
    groups = pq.ParquetFile(cut).metadata
    assert groups.num_row_groups > 3 and max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) < 20


def test_pieces_are_written_in_as_few_files_as_they_need(spark):
    docs = spark.range(0, 400, 1, 40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a word "), (F.col("id") % 50).cast("int")).alias("text"))
    before = folders(spark, "pieces")
    got = packing.pack(packing.pieces(docs))
    assert len(files_of(spark, "pieces", before)) == 1
    whole = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert got.select("doc_id").distinct().count() == 400 and whole.where("n > 1024 or first <> 0 or end <> n").isEmpty()
    assert got.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where("n <> doc_tokens").isEmpty()


def test_small_stars_are_not_cut(spark):
    """A centre goes once to the group of a small star, not to a cell for each member."""
    carried = spark.range(1000).select("id", F.lit(1).cast("long").alias("n"), F.lit(b"x").alias("data"))
    pairs = spark.range(1000).where("id % 10 > 0").select((F.col("id") - F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    rows = hyperminhash.stars(pairs, carried)
    assert rows.where("role = 0").count() == 100 and rows.where("role = 1").count() == 900
