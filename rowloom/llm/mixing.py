"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources weigh 3, 1, 2, repeating, in code point order (null last), and share 150 % of all
words; no target exceeds twice its source, and what is cut off is shared again by weight.

Drawing: every document belongs to one of ``BLOCKS`` blocks of its source, by a keyed hash of its
id. A source's blocks stand in a keyed random order, once for each time the mix may take them; the
mix takes slots of this row until the target is met. Where the target ends inside a block, that
block is cut by ``BLOCKS`` finer ranges of the same hash, and the range it ends in by document. The
slots taken are then dealt to output shards by the tree: each node splits its exact quotas of
every source in two by a multivariate-hypergeometric draw, so each shard gets a sample of the
sources as if all slots had been shuffled, and shards never share a slot. Inside a shard documents
are ordered by another hash.

Sources may be many (web domains): their blocks, targets and slots are tables, joined without a hint. The
water level that fills the targets is found by a few aggregates over the sources; the driver holds
``CHUNKS`` quotas of the tree's upper part, whose chunks of sources are dealt on among their own by the same
draw. All randomness is a function of the seed and ids, so reruns agree.

Defined cases: null texts have size 0; a source whose texts are all empty has target 0 and takes
nothing; an empty table gives an empty result; repeated doc_ids are taken or left together; a
null doc_id is an id of its own; columns other than those named aren't used for the decision, and
``mix`` returns them unchanged (but for its own two).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.prefix import ordinals
from .common import WORD, materialise

BLOCKS, SHARDS, SEED = 64, 16, 20240601
CHUNKS = 1024
CYCLE, SHARE, CAP = (3, 1, 2), 1.5, 2


def targets(sizes: list[tuple[str | None, int]], cycle=CYCLE, share=SHARE, cap=CAP) -> dict[str | None, float]:
    """Water filling: sources at their cap keep it, the others share what is left by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: cycle[i % len(cycle)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, out = share * sum(size.values()), set(size), {}
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total >= cap * size[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: float(cap * size[s]) for s in full}
        left -= sum(cap * size[s] for s in full)
        free -= full
    return out


def split_tree(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Deal exact quotas (slots of each source) to shards: rows are shards, columns sources."""
    out = np.zeros((shards, len(quota)), dtype=np.int64)

    def node(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1 or not have.sum():
            out[first] = have
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        draw = int(have.sum()) * (middle - first) // (last - first)
        left = rng.multivariate_hypergeometric(have, draw, method="marginals")
        node(first, middle, left)
        node(middle, last, have - left)

    node(0, shards, quota.astype(np.int64))
    return out


def filled(sources: DataFrame, cycle=CYCLE, share=SHARE, cap=CAP) -> DataFrame:
    """``targets`` for a table of sources (source, source_size), of any number: with ``place``, the source's place
    in code point order, and ``target``.

    A source is at its cap where cap * size <= level * weight. The level is what is left for the others, by
    their weight; it only rises, so rounds end when no more sources reach their cap."""
    placed = ordinals(sources.withColumn("none", F.col("source").isNull()), ["none", "source"], "place").drop("none")
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod("place", F.lit(len(cycle))) + 1).cast("int"))
    placed = materialise(placed.withColumn("weight", weight), "sources")
    sums = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not sums["weight"]:
        return placed.withColumn("target", F.lit(0.0))
    goal, level, at_cap = share * sums["size"], share * sums["size"] / sums["weight"], -1
    while True:
        full = F.col("source_size") * F.lit(cap) <= F.lit(level) * F.col("weight")
        got = placed.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("size"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if got["n"] == at_cap or not got["free"]:
            return placed.withColumn("target", F.when(full, (F.col("source_size") * F.lit(cap)).cast("double")).otherwise(F.lit(level) * F.col("weight")))
        at_cap, level = got["n"], (goal - cap * (got["size"] or 0)) / got["free"]


def dealt_slots(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """place, upto: for each source (place, slots), how many of its slots are in the shards up to each one."""
    chunked = quotas.withColumn("chunk", F.pmod("place", F.lit(CHUNKS)).cast("int"))
    # CHUNKS rows at most.
    tops = sorted((r["chunk"], r["slots"]) for r in chunked.groupBy("chunk").agg(F.sum("slots").alias("slots")).collect())
    dealt = split_tree(np.array([n for _, n in tops] or [0]), shards, seed)
    have = {c: dealt[:, k] for k, (c, _) in enumerate(tops)}

    def deal(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("place")
        left, out = b["slots"].to_numpy(dtype=np.int64), np.zeros((shards, len(b)), dtype=np.int64)
        for shard, n in enumerate(have[key[0]]):
            rng = np.random.default_rng([seed, int(key[0]), shard])
            out[shard] = left if len(b) == 1 and shard == shards - 1 else rng.multivariate_hypergeometric(left, int(n), method="marginals")
            left = left - out[shard]
        return pd.DataFrame({"place": b["place"], "upto": list(out.cumsum(axis=0).T)})

    return chunked.groupBy("chunk").applyInPandas(deal, "place long, upto array<long>")


def _block(key: Column, level: int) -> Column:
    return F.pmod(F.shiftright(key, 16 * level), F.lit(BLOCKS)).cast("int")


def plan(docs: DataFrame, doc_id="doc_id", text="text", source="source", seed: int = SEED, shards: int = SHARDS):
    """The decision: a table doc_id, source, size, source_size, target, copies, first_shard,
    second_shard with one row for each row of docs."""
    key = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"))
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), key.alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = materialise(sized.withColumn("block", _block(F.col("key"), 0)).withColumn("range", _block(F.col("key"), 1)), "sizes")
    # One row for each (source, block): BLOCKS rows a source at most.
    blocks = materialise(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    goals = materialise(filled(blocks.groupBy("source").agg(F.sum("words").alias("source_size"))), "targets")
    of = goals.select(F.col("source").alias("of_source"), "place", "source_size", "target")
    # A source's blocks in keyed random order; the passes follow each other, each over blocks with words.
    of_source = W.partitionBy("place")
    order = of_source.orderBy(F.xxhash64(F.lit(seed), F.lit("blocks"), "of_source", "block"), "block")
    live = F.col("words") > 0
    row = blocks.join(of, F.col("source").eqNullSafe(F.col("of_source"))).drop("source")
    row = row.withColumn("before", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    row = row.withColumn("at", F.sum(live.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).withColumn("n", F.sum(live.cast("long")).over(of_source))
    left = [F.col("target") - F.col("before") - F.col("source_size") * F.lit(k) for k in range(CAP)]
    row = row.withColumn("whole", sum((live & (x >= F.col("words"))).cast("int") for x in left))
    row = row.withColumn("cut_words", F.coalesce(*[F.when(live & (x > 0) & (x < F.col("words")), x) for x in left]))
    row = materialise(row.withColumn("slots", sum((live & (x > 0)).cast("int") for x in left)), "slots")
    quotas = row.groupBy("place").agg(F.sum("slots").alias("slots"))
    dealt = dealt_slots(quotas, shards, seed)

    def shard(k: int) -> Column:
        return F.when(F.col("slots") > k, F.size(F.filter("upto", lambda upto: upto <= F.col("at") + F.col("n") * F.lit(k))).cast("int"))

    table = row.join(dealt, "place").select(
        "of_source", F.col("block").alias("of_block"), "source_size", "target", "whole", "cut_words", shard(0).alias("first_shard"), shard(1).alias("second_shard")
    )
    # Spark broadcasts this table where its measured size allows, and deals both sides by block where not: a source's
    # rows, however many, are spread over its blocks.
    table = materialise(table, "plan")
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("block") == F.col("of_block"))
    sized = sized.join(table, same).drop("of_source", "of_block")
    # The one block of each source that the target cuts: by its ranges, then by document.
    cut = sized.where(F.col("cut_words").isNotNull())
    ranges = cut.groupBy("source", "block", "range", "cut_words").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source", "block").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", "words", (F.col("cut_words") - F.coalesce(F.sum("words").over(before), F.lit(0))).alias("room"))
    inside = cut.alias("c").join(
        ranges.where("room > 0").alias("r"), F.col("c.source").eqNullSafe(F.col("r.source")) & (F.col("c.range") == F.col("r.range"))
    ).select("c.source", "c.range", "c.doc_id", "c.key", "c.size", "r.room", "r.words")
    ids = inside.groupBy("source", "range", "doc_id", "key", "room", "words").agg(F.sum("size").alias("words_of_id"))
    upto = W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    reached = F.when(F.col("words") <= F.col("room"), F.lit(0)).otherwise(F.sum("words_of_id").over(upto) - F.col("words_of_id") / 2)
    taken = ids.where("words_of_id > 0").select(F.col("doc_id").alias("id_"), F.col("source").alias("source_"), "room", reached.alias("reached")).where("reached <= room")
    taken = taken.select("id_", "source_", F.lit(1).alias("extra"))
    on = F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & F.col("cut_words").isNotNull()
    return sized.join(taken, on, "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.col("whole")).cast("int").alias("copies"),
        "first_shard", "second_shard",
    )


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The mix itself: rows of docs, each as often as the plan takes it, with ``mix_shard`` and
    ``mix_order``, the place in its shard; older columns of these names give way."""
    p = plan(docs, doc_id, text, source, seed, shards)
    p = p.where("copies > 0").groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source")).agg(
        F.max("copies").alias("copies"), F.first("first_shard").alias("s0"), F.first("second_shard").alias("s1")
    )
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_shard", "mix_order")]).alias("row"))
    rows = row.join(p, F.col(f"row.`{doc_id}`").eqNullSafe(F.col("mix_id")) & F.col(f"row.`{source}`").cast("string").eqNullSafe(F.col("mix_source")))
    shard = F.explode(F.slice(F.filter(F.array("s0", "s1"), lambda x: x.isNotNull()), F.lit(1), F.col("copies")))
    rows = rows.select("row", shard.alias("mix_shard")).select("row.*", "mix_shard")
    return rows.withColumn("mix_order", F.xxhash64(F.lit(seed + 1), F.col("mix_shard"), F.col(doc_id).cast("string")))
