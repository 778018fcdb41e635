"""A corpus from documents to token ids: each stage reads all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. Stages but the last return the columns of
documents. All stages take rows as they come: null or empty texts are clean, are copies of
each other, are near to nothing, add no words to a mix (size 0) and encode to no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import chunk_dedup, hyperminhash, mixing, pu_toxicity, sentencepiece_table
from rowloom.llm.common import materialise, split_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = pu_toxicity.fit(docs, labels, split_of("doc_id", 5) != 0)
    return pu_toxicity.keep_clean(docs, model).select(*COLUMNS)


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of docs that were kept; a row that repeats a kept id goes with all but one of its kind."""
    ids = decided.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return _kept(docs, chunk_dedup.exact_groups(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return _kept(docs, hyperminhash.near_groups(docs, size=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: rows stand in it as often as it takes them."""
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and token ids of each row of the mix, the digest of what they decode to, and whether
    that is the text (a null text's is the empty one)."""
    rows = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = sentencepiece_table.encode(rows, keep=["doc_id", "source", "text_sha256"], decoded=True)
    same = F.col("decoded_sha256") == F.col("text_sha256")
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256", same.alias("round_trip"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("sentencepiece", encode)]

#: Trained scores, seeded draws and a tokenizer aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
