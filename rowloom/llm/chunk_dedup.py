"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

Each text (runs of ``[\\x20\\x09-\\x0D]`` made one space) is cut where its content says so: behind a
window of eight characters that meets a fixed condition, between ``MIN_CHUNK`` and ``MAX_CHUNK``
characters from the cut before, so texts that differ at one place fall into step again behind it,
and equal texts have equal chunks. A chunk's identifier is its fingerprint (128 bits: two hashes of different seeds) and a rank;
ranks other than 0 exist only where different contents share a fingerprint, which is found by comparing the
distinct contents of all chunks once. Documents are then compared by their ordered lists of identifiers, some 20
bytes for each few hundred characters of text; texts are dealt out once, as distinct chunks. Where
contents do share a fingerprint, the distinct texts that hold it, and only those, are looked at again.

Defined cases: a null text equals the empty text, whose recipe is the empty list; ties and repeated
rows group with their copies and the smallest doc_id stays (a null doc_id is larger than any other);
of rows that repeat the doc_id that stays as well, all are marked kept, as they can't be told
apart by id; an empty table gives an empty result; columns other than the id and the text are
not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

MIN_CHUNK, MAX_CHUNK = 128, 4096


def _class(bit: int) -> str:
    """ASCII characters whose code has this bit, and all others."""
    return "[" + "".join(f"\\x{c:02x}" for c in range(32, 127) if c >> bit & 1) + r"\x80-\x{10FFFF}]"


#: A cut follows eight characters whose codes have these bits: one place in 256 of mixed text.
CUT_AFTER = "".join(_class(bit) for bit in (0, 1, 2, 0, 1, 3, 0, 1))
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{CUT_AFTER}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    """Runs of white space as one space. Single spaces, the common case, aren't matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][\t-\r ]*| [\t-\r ]+", " ")


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def wide(chunk) -> Column:
    """128 bits of a chunk."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(77), chunk).alias("b"))


def colliding_chunks(docs: DataFrame, text: str = "text", fingerprint=wide) -> DataFrame:
    """(fp, chunk, rank) of chunks whose fingerprint other contents have as well."""
    distinct = (
        docs.select(F.explode(chunks(normalised(F.col(text)))).alias("chunk"))
        .select(fingerprint("chunk").alias("fp"), "chunk")
        .groupBy("fp", "chunk")
        .agg(F.count("*").alias("copies"))
    )
    shared = distinct.groupBy("fp").agg(F.count("*").alias("contents")).where("contents > 1")
    shared = materialise(shared.select("fp"), "fps")
    if shared.isEmpty():
        return shared.select("fp", F.lit("").alias("chunk"), F.lit(0).alias("rank"))
    smaller = distinct.join(shared, "fp", "left_semi").select("fp", "chunk")
    rank = F.row_number().over(W.partitionBy("fp").orderBy("chunk")) - 1
    return materialise(smaller.withColumn("rank", rank), "ranks")


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprint=wide) -> DataFrame:
    """One row for each row of docs: doc_id, text_sha256, salt and recipe, the ordered identifiers."""
    salts = max(64, shuffle_partitions(docs.sparkSession))
    found = colliding_chunks(docs, text, fingerprint)
    base = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm"))
    base = base.withColumn("text_sha256", F.sha2("norm", 256))
    plain = F.transform(chunks(F.col("norm")), lambda c: F.struct(fingerprint(c).alias("fp"), F.lit(0).alias("rank")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    rows = materialise(base.select("doc_id", "text_sha256", salt.alias("salt"), plain.alias("recipe")), "recipes")
    if found.isEmpty():
        return rows
    # Only texts with a shared fingerprint: each distinct one once, its ranks looked up and its list put together again.
    fps = found.select("fp").distinct()
    holders = rows.select("text_sha256", F.explode(F.array_distinct(F.transform("recipe", lambda x: x["fp"]))).alias("fp")).join(fps, "fp", "left_semi")
    holders = materialise(holders.select("text_sha256").distinct(), "holders")
    texts = base.select("text_sha256", "norm").join(holders, "text_sha256", "left_semi").dropDuplicates(["text_sha256"])
    each = texts.select("text_sha256", F.posexplode(chunks(F.col("norm"))).alias("pos", "chunk")).withColumn("fp", fingerprint("chunk"))
    ranked = each.join(found, ["fp", "chunk"], "left").select("text_sha256", "pos", F.struct("fp", F.coalesce("rank", F.lit(0)).alias("rank")).alias("id"))
    lists = ranked.groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("parts"))
    lists = lists.select("text_sha256", F.transform("parts", lambda p: p["id"]).alias("ranked"))
    # Copies of one text may be many: they meet its list by salt.
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(lists, ["text_sha256", "salt"], "left").select("doc_id", "text_sha256", "salt", F.coalesce("ranked", "recipe").alias("recipe"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprint=wide) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    A group of copies may hold a third of all rows: it is counted by (recipe, salt) first, and the
    answer goes back to its members by (recipe, salt) too, so no task meets a whole group."""
    rows = recipes(docs, doc_id, text, fingerprint)
    part = rows.groupBy("recipe", "salt").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    whole = part.groupBy("recipe").agg(
        F.sum("n").alias("group_size"), F.min("least").alias("keep_id"), F.collect_set("salt").alias("salts")
    )
    answer = whole.select("recipe", "group_size", "keep_id", F.explode("salts").alias("salt"))
    return rows.join(answer, ["recipe", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
