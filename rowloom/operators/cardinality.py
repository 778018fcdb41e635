"""Children for each parent: exact totals in closed form, over any number of parents."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigInvalid
from ..functions import rng
from ..scratch import materialise
from .prefix import running_before
from .unique import permuted


@dataclass(frozen=True)
class Cardinality:
    low: int
    high: int
    distribution: str = "uniform"
    options: tuple[tuple[str, float], ...] = ()


def parse_range(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"\s*(\d+)\s*\.\.\s*(\d+)\s*", text)
    if not m or int(m[1]) > int(m[2]):
        raise ConfigInvalid(f"'{text}' is no range like 1..5")
    return int(m[1]), int(m[2])


def from_config(value) -> Cardinality:
    """'1..5', {'cardinality': '1..5', 'distribution': 'zipf'}, or a list of counts."""
    if isinstance(value, str):
        return Cardinality(*parse_range(value))
    if isinstance(value, (list, tuple)):
        return Cardinality(min(value), max(value))
    spec = value.get("cardinality", "0..1")
    low, high = parse_range(spec) if isinstance(spec, str) else (min(spec), max(spec))
    return Cardinality(low, high, value.get("distribution", "uniform"), tuple(sorted((k, float(v)) for k, v in value.get("options", {}).items())))


def allocate(parents: DataFrame, total: int, spec: Cardinality, share="share", order="ord") -> DataFrame:
    """parents with ``n_children``, which adds up to total. parents: distinct ``ord`` 0..P-1, ``share`` in [0, 1].

    Wanted counts low + share * (high - low) are scaled to the total; what rounding leaves goes to
    (or comes from) parents in order, as far as their bounds allow, and the rest to the first."""
    c = parents.withColumn("__c", rng.half_up(F.lit(spec.low) + F.col(share) * F.lit(spec.high - spec.low)))
    sums = c.agg(F.count("*").alias("p"), F.sum("__c").alias("s")).first()
    p, s = int(sums["p"]), int(sums["s"] or 0)
    if p == 0 or total == 0:
        return c.withColumn("n_children", F.lit(0).cast("long")).drop("__c")
    if s == 0:
        return c.withColumn("n_children", (F.lit(total // p) + (F.col(order) < F.lit(total % p)).cast("int")).cast("long")).drop("__c")
    if s != total:
        c = c.withColumn("__c", rng.half_up(F.col("__c") * F.lit(total) / F.lit(s)))
        s = int(c.agg(F.sum("__c")).first()[0])
    gap = total - s
    if gap > 0:
        c = c.withColumn("__cap", F.greatest(F.lit(spec.high) - F.col("__c"), F.lit(0)).cast("long"))
        room = int(c.agg(F.sum("__cap")).first()[0])
        c = running_before(c, "__cap", order, "__pre")
        c = c.withColumn("__c", F.col("__c") + F.least(F.col("__cap"), F.greatest(F.lit(gap) - F.col("__pre"), F.lit(0))) + F.when(F.col(order) == 0, F.lit(max(gap - room, 0))).otherwise(0))
        c = c.drop("__cap", "__pre")
    elif gap < 0:
        for floor in (spec.low, 0):
            if gap == 0:
                break
            c = c.withColumn("__cap", F.greatest(F.col("__c") - F.lit(floor), F.lit(0)).cast("long"))
            room = int(c.agg(F.sum("__cap")).first()[0])
            c = running_before(c, "__cap", order, "__pre")
            c = c.withColumn("__c", F.col("__c") - F.least(F.col("__cap"), F.greatest(F.lit(-gap) - F.col("__pre"), F.lit(0)))).drop("__cap", "__pre")
            gap = min(0, gap + room)
    return c.withColumn("n_children", F.col("__c").cast("long")).drop("__c")


#: Children that a task makes, about: parents are small, so their own number of tasks says little.
CHILDREN = 2_000_000


def expand(parents: DataFrame, seed: int, table: str, column: str, keys: list[str]) -> DataFrame:
    """One row a child: the parent's keys and a shuffled ``child_ord`` 0..T-1. parents: distinct ``ord``.

    Children stand behind those of earlier parents, and their places are permuted by arithmetic: only parents are summed
    (and written once), and children are made where their parent is, so they aren't sorted, moved or written."""
    some = parents.where("n_children > 0").select(*keys, "ord", F.col("n_children").cast("long").alias("n_children"))
    held = materialise(running_before(some, "n_children", "ord", "__before").drop("ord"), "parents")
    total = int(held.agg(F.sum("n_children")).first()[0] or 0)
    tasks = -(-total // CHILDREN)
    dealt = held.repartition(tasks, "__before") if tasks > 1 else held
    each = dealt.select(*keys, "__before", F.explode(F.sequence(F.lit(1), F.col("n_children").cast("int"))).alias("__k"))
    if total == 0:
        return each.select(*keys, F.lit(0).cast("long").alias("child_ord"))
    drawn = crc32(f"{seed}|{table}|{column}".encode())
    each = each.select(*keys, permuted(F.col("__before") + F.col("__k") - 1, total, drawn).alias("child_ord"))
    for again in range(2):  # some places change with their mirror images, so that siblings lie at no regular distance
        mirror = F.pmod(F.lit((drawn * (2 * again + 3) + again) % total) - F.col("child_ord"), F.lit(total))
        each = each.withColumn("__mirror", mirror)
        chosen = F.xxhash64(F.lit(drawn + again), F.greatest("child_ord", "__mirror")) % 2 == 0
        each = each.select(*keys, F.when(chosen, F.col("child_ord")).otherwise(F.col("__mirror")).alias("child_ord"))
    return each
