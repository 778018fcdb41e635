"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chunk_dedup, feistel, fm_quality, hyperminhash, jacobi_whitening, line_blocks, lm_interpolation, mixing, packing, pu_toxicity, raster, sentencepiece_table
from .common import documents, split_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    model = pu_toxicity.fit(docs, labels, split_of("doc_id", 5) != 0)
    scored = pu_toxicity.score(docs, model)
    return scored.select("doc_id", (split_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(_table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_groups(documents(spark, sf_dir), size=2, percent=80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    model = fm_quality.fit(docs, labels, split_of("doc_id", 4) != 2)
    scored = fm_quality.score(docs, model)
    return scored.select("doc_id", (split_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = raster.text_features(documents(spark, sf_dir))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_interpolation.score(documents(spark, sf_dir), split_of("doc_id", 7) != 2)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.digests(documents(spark, sf_dir))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(documents(spark, sf_dir))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "first_shard", "second_shard")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_groups(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return jacobi_whitening.components(vectors, jacobi_whitening.fit(vectors))


OPERATORS = (op1_toxicity, op2_pseudonyms, op3_main_text, op4_near_dedup, op5_quality, op6_media, op7_lm_score, op8_sentencepiece, op9_mix, op10_exact_dedup, op11_packing, op12_alignment, op13_whitening)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op10_exact_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
                 g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)""",
        "op4_near_dedup": rf"""
            WITH RECURSIVE
            w AS (SELECT doc_id, list_filter(string_split_regex({lowered}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
                         ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
            n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
            e AS (SELECT doc_id, unnest(sh) AS x FROM s),
            i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS (SELECT i.a, i.b FROM i JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * i.i >= 80 * (na.n + nb.n - i.i)),
            u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
            r AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.d)
            SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id, n.doc_id = min(r.m) AS kept
            FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n""",
    }
