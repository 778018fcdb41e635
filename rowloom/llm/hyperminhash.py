"""Near-duplicates by HyperMinHash registers, verified on full shingle sets.

Each distinct shingle is hashed once; some bits name one of ``BUCKETS`` buckets, and of the rest
the smallest value of each bucket is kept as a 16-bit register: its leading-zero count (6 bits) and
the 10 bits behind the first one (mantissa). Buckets that a short text leaves empty borrow from a
filled one in an order fixed for the bucket, so registers of texts of any length agree with
probability J. Groups of ``BAND`` registers are the keys under which candidates meet; the Jaccard
index is then estimated from all registers, corrected for registers that agree by chance, and
pairs estimated clearly too low are left out before the sets themselves are compared.

With 160 independent registers in 32 bands of 5, a pair at exactly 0.8 shares no band with probability
(1 - 0.8**5)**32 = 3e-6, and falls 0.15 (almost five deviations) under 0.8 with 1e-6. Borrowed registers are
not independent: of 400 000 simulated pairs with unions of 5 to 40 shingles, 4 to 8 a size shared no band
(1e-5 to 2e-5), and 21 to 165 fell under that margin. So the margin widens as buckets stay empty, and pairs
with fewer than ``SPARSE`` shingles are not estimated; of the same pairs none is lost by the margin.

No pair list within a group of copies is made:
1. documents with equal shingle sets are one class, whose id is a hash of its set;
2. in each band's bucket every class is compared with the one of smallest id only; what is linked is
   joined to components;
3. what that leaves apart from its bucket's largest component is compared with one of its members,
   another one in each bucket, so that a group whose texts drift apart is found from many sides;
4. only then are classes of one bucket compared with classes of other components in it - all of
   them, in blocks of bounded size that are spread over tasks, so large buckets need no cap.
The result is the components of all links that any bucket offers. In joins by a centre or a component's label, keys that
a million rows or more have (``HEAVY``) are dealt to tasks by salts.

Defined cases: null, empty or wordless texts have 0 shingles and link with nothing, whatever their id; with fewer words
than a shingle takes, the whole sequence is the one shingle; repeated rows (same id too) share
a component; rows that repeat an id with other texts are one document, linked through each of its texts; rows with a null id are put out as they are, with themselves as component; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, drop, materialise, shuffle_partitions, words

BUCKETS, BAND = 160, 5
MANTISSA_BITS, ZERO_BITS = 10, 6
MARGIN = 0.15
SPARSE, BORROWED = 32, 0.07  # shingles under which no estimate counts; what the margin gains where all registers are borrowed
BLOCK = 128  # classes that are compared with as many others at once
WIDE = 5000  # rows a scratch file, where rows hold registers or sets
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are kept in a bounded table."""

    def __init__(self, size: int, table_size: int = 400_000):
        import xxhash

        self.size, self.table, self.table_size, self.of = size, {}, table_size, xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        ws = words(text)
        if not ws:
            return np.empty(0, dtype=np.uint64)
        table, of = self.table, self.of
        if len(table) > self.table_size:
            table.clear()
        hashed = []
        for w in ws:
            h = table.get(w)
            if h is None:
                h = of(w)
                if len(w) <= 64:
                    table[w] = h
            hashed.append(h)
        h = np.array(hashed, dtype=np.uint64)
        n = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def borrow_order(buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, the order in which it asks others when empty."""
    rng = np.random.default_rng(77)
    return np.stack([rng.permutation(buckets) for _ in range(buckets)])


def registers(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """uint16 registers; shingles must be sorted and not empty."""
    buckets = len(order)
    x = mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    least = np.full(buckets, EMPTY)
    np.minimum.at(least, (x % np.uint64(buckets)).astype(np.int64), mix64(x))
    filled = least != EMPTY
    if not filled.all():
        empty = np.flatnonzero(~filled)
        asked = order[empty]
        least[empty] = least[asked[np.arange(len(empty)), filled[asked].argmax(1)]]
    # Leading zeros (to 63) and the bits behind the first one; float64 keeps the top 53 bits.
    exponent = np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, (1 << ZERO_BITS) - 1).astype(np.uint64)
    mantissa = ((least << zeros) >> np.uint64(63 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    return (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)


def chance(sizes_a, sizes_b, buckets: int = BUCKETS) -> np.ndarray:
    """Expected share of registers of unrelated sets that agree by chance: smallest values of
    rates a and b fall into the same octave, and then share a mantissa one time in 2**10.

    Over octaves [2**-(z+1), 2**-z) of the unit interval, with rates n/buckets."""
    a = np.maximum(1.0, np.asarray(sizes_a, dtype=float) / buckets)[..., None]
    b = np.maximum(1.0, np.asarray(sizes_b, dtype=float) / buckets)[..., None]
    z = np.arange(40)
    low, high = 2.0 ** -(z + 1), 2.0**-z
    return ((np.exp(-a * low) - np.exp(-a * high)) * (np.exp(-b * low) - np.exp(-b * high))).sum(-1) / (1 << MANTISSA_BITS)


def estimate(agree: np.ndarray, sizes_a, sizes_b) -> np.ndarray:
    """Collision-corrected Jaccard estimate from the share of registers that agree."""
    c = chance(sizes_a, sizes_b)
    return (agree - c) / (1 - c)


def likely(near: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether estimates aren't clearly too low. Borrowed registers repeat each other: the fewer buckets a set
    fills, the wider the margin, and the sets of pairs with fewer than SPARSE shingles are compared in any case."""
    least = np.minimum(sizes_a, sizes_b)
    return (least < SPARSE) | (near >= percent / 100 - MARGIN - BORROWED * np.exp(-least / BUCKETS))


def sketches(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes, of the whole sorted set), regs (binary)."""
    order = borrow_order()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingle = Shingler(size)
        for b in batches:
            rows = []
            for t in b["text"]:
                s = shingle(t)
                raw = s.tobytes()
                rows.append((len(s), xxhash.xxh3_128_digest(raw), registers(s, order).tobytes()) if len(s) else (0, None, None))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_shingles", "set_key", "regs"])], axis=1)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_shingles long, set_key binary, regs binary")


#: A key with so many rows, and this share of all, is dealt to tasks by salts; so there are few such keys.
HEAVY, HEAVY_SHARE = 1_000_000, 1000


def dealt_join(left: DataFrame, key: str, seat: str, right: DataFrame, right_key: str, n_left: int) -> DataFrame:
    """left joined with the right row of its key. Keys that very many left rows have (a star's centre, a component's
    label) are dealt out by the row's seat, and the right row goes to each salt. Such keys are counted first, if left
    is large enough to have any; there can be ``HEAVY_SHARE`` of them at most, so the driver holds them."""
    heavy: list[int] = []
    if n_left >= HEAVY:
        least = max(HEAVY, n_left // HEAVY_SHARE)
        heavy = [r[key] for r in left.groupBy(key).count().where(F.col("count") >= least).select(key).collect()]
    if not heavy:
        return left.join(right, left[key] == right[right_key])
    salts = max(64, shuffle_partitions(left.sparkSession))
    dealt = left.withColumn("_salt", F.when(F.col(key).isin(heavy), F.pmod(F.xxhash64(seat), F.lit(salts)).cast("int")).otherwise(0))
    each = F.when(F.col(right_key).isin(heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.withColumn("_of", F.explode(each))
    return dealt.join(spread, (dealt[key] == spread[right_key]) & (dealt["_salt"] == spread["_of"])).drop("_salt", "_of")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): least id reachable. Labels move along links and
    through the labels' own labels, so chains shorten by halves."""
    both = compact(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    held = labels = compact(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while both.n_rows:
        near = dealt_join(both, "b", "a", labels, "id", both.n_rows).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        if held.n_rows >= HEAVY:
            own = compact(own, "own")  # it is counted and joined with itself
        up = own.select(F.col("id").alias("up"), F.col("new").alias("up_label"))
        step = dealt_join(own, "new", "id", up, "up", held.n_rows).select("id", "old", F.least("new", "up_label").alias("label"))
        last, step = held, compact(step, "step")
        held = step
        drop(last)
        changed = not step.where("label <> old").isEmpty()
        labels = step.select("id", "label")
        if not changed:
            break
    drop(both)
    return labels.select("id", F.col("label").alias("component"))


def full_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """id and set (sorted shingle hashes) of the classes whose id is in wanted. A class's set is read from a document
    with its least doc_id whose set is the class's: other rows may have the same doc_id."""
    named = compact(wanted.distinct().join(classes.select("id", "rep", "set_key"), "id"), "ids")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingle = Shingler(size)
        for b in batches:
            data = [shingle(t).tobytes() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "own_key": [xxhash.xxh3_128_digest(x) for x in data], "set": data})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(named.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    found = rows.mapInPandas(sets, "doc_id long, own_key binary, set binary")
    # Equal rows of one class repeat its set; documents of one id are few, so these are few. They meet where the join brought them.
    found = found.join(named, (found["doc_id"] == named["rep"]) & (found["own_key"] == named["set_key"])).dropDuplicates(["doc_id", "own_key"]).select("id", "set")
    return compact(found, "sets", WIDE)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


STAR = ["a", "cell"]
CELL = 256  # members, and a share of all, from which a star is dealt to cells


def stars(pairs: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows of pairs (a, b) as sorted groups (a, cell): the centre's row (role 0) and then its members', each with its
    n and data from carried (id, n, data). A centre may have a third of all ids as members: the members of such ones are
    dealt to cells by hash, the centre goes to each of its cells once, and nothing is copied to a pair. Other stars are
    a cell. Large stars are counted first; there can be ``HEAVY_SHARE`` of them at most, so the driver holds them."""
    spark = pairs.sparkSession
    cells = max(64, shuffle_partitions(spark))
    n = pairs.__dict__.get("n_rows")
    least = max(CELL, -(-(pairs.count() if n is None else n) // HEAVY_SHARE))
    large = [r["a"] for r in pairs.groupBy("a").count().where(F.col("count") >= least).select("a").collect()]
    cell = F.when(F.col("a").isin(large), F.pmod(F.xxhash64("b"), F.lit(cells))).otherwise(0) if large else F.lit(0)
    dealt = pairs.select("a", cell.cast("int").alias("cell"), "b")
    members = dealt.join(carried, dealt["b"] == carried["id"]).select("a", "cell", F.lit(1).alias("role"), "b", "n", "data")
    centres = dealt.select("a", "cell").distinct().join(carried, F.col("a") == carried["id"]).select("a", "cell", F.lit(0).alias("role"), F.col("a").alias("b"), "n", "data")
    return members.unionAll(centres).repartition(shuffle_partitions(spark), *STAR).sortWithinPartitions(*STAR, "role", "b")


def centred(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, bytes, int, int]]]]:
    """Each batch of sorted rows with its runs of members: the centre's n and data, first and last + 1 row; memory holds a
    batch and a centre, however many members there are."""
    n = data = None
    for b in batches:
        at = np.flatnonzero(b["role"].to_numpy() == 0)
        ends, of_n, of_data = [*at.tolist(), len(b)], b["n"].to_numpy(), b["data"].to_numpy()
        runs = [(n, data, 0, ends[0])] if ends[0] else []
        for s, e in zip(ends, ends[1:], strict=False):
            n, data = of_n[s], of_data[s]
            if e > s + 1:
                runs.append((n, data, s + 1, e))
        yield b, runs


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Pairs (a, b) of class ids whose full shingle sets meet 100 * intersection >= percent * union."""
    full = full_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), classes, size, doc_id, text)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, runs in centred(batches):
            ok, data = np.zeros(len(rows), dtype=bool), rows["data"].to_numpy()
            for _, x, s, e in runs:
                of = np.frombuffer(x, dtype=np.uint64)
                ok[s:e] = [similar(of, np.frombuffer(y, dtype=np.uint64), percent) for y in data[s:e]]
            yield rows.loc[ok, ["a", "b"]]

    carried = full.select("id", F.lit(0).cast("long").alias("n"), F.col("set").alias("data"))
    out = compact(stars(pairs, carried).mapInPandas(meet, "a long, b long"), "met")
    drop(full)
    return out


def same_id(live: DataFrame) -> DataFrame:
    """Links (a, b) between classes that rows of one doc_id are in: a document is linked through each of its rows."""
    of = live.select("doc_id", F.xxhash64("set_key").alias("id"))
    ends = of.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a <> most").select(F.col("doc_id").alias("of_id"), "a")
    return of.join(ends, of["doc_id"] == ends["of_id"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of docs."""
    spark = docs.sparkSession
    salts = max(64, shuffle_partitions(spark))
    rows = materialise(sketches(docs, size, doc_id, text).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")), "sketches")
    live = rows.where("n_shingles > 0 and doc_id is not null")
    # 1. Classes of equal sets. A class may hold a third of all rows: a task sends one row of it. Their ids come from their sets.
    whole = live.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"), F.first("n_shingles").alias("n"), F.collect_set("salt").alias("salts"))
    whole = compact(whole.withColumn("id", F.xxhash64("set_key")), "classes", WIDE)
    classes = whole.select("id", "rep", "set_key", "n", "regs")
    members = whole.select("set_key", "rep", "id", F.explode("salts").alias("salt"))
    links = class_links(docs, classes, same_id(live), size, percent, doc_id, text)
    all_parts = components(links)
    # A component's name is the least doc_id in it.
    named = classes.join(all_parts, "id", "left").select("id", "rep", F.coalesce("component", "id").alias("part"))
    least = named.groupBy("part").agg(F.min("rep").alias("component"))
    named = compact(dealt_join(named, "part", "id", least.withColumnRenamed("part", "of"), "of", whole.n_rows).select(F.col("id").alias("of_id"), "component"), "named")
    of_rows = members.join(named, members["id"] == named["of_id"]).select("set_key", "salt", "component")
    out = rows.join(of_rows, ["set_key", "salt"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def class_links(docs: DataFrame, classes: DataFrame, given: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between the ids of classes that connect all that similarity connects, beside those given."""
    # From here on, rep is a class's id.
    sketched = classes.select(F.col("id").alias("rep"), "n", "regs")
    # 2. Keys: band number and registers. Stars first.
    bands = BUCKETS // BAND
    keyed = sketched.select(
        "rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring("regs", i * (2 * BAND) + 1, F.lit(2 * BAND)))).alias("band", "part")
    ).select("rep", "band", F.xxhash64("band", "part").alias("key"))
    met = compact(keyed.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("classes")).where("classes > 1").select("key", "a"), "met")
    if not met.n_rows:
        return given
    shared = compact(keyed.join(met, "key"), "shared")
    star = compact(shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    star = compact(plausible(star, sketched, percent), "star")
    links = verify(docs, star, classes, size, percent, doc_id, text) if star.n_rows else star
    links = links.union(given)
    # 3. and 4. What the stars left apart, in the buckets that hold more than one component.
    shared = shared.select("key", "band", "rep")
    apart = unsettled(shared, links)
    if not apart.n_rows:
        return links
    inside = apart.where("component = main").groupBy("key").agg(F.min_by("rep", F.xxhash64("key", "rep")).alias("inside"))
    around = apart.where("component <> main").join(compact(inside, "inside"), "key")
    around = around.select(F.least("rep", "inside").alias("a"), F.greatest("rep", "inside").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    around = compact(around, "pairs")
    around = compact(plausible(around, sketched, percent), "around")
    if around.n_rows:
        links = compact(links.union(verify(docs, around, classes, size, percent, doc_id, text)), "known")
        apart = unsettled(shared, links)
    return links.union(cross_links(apart, classes, size, percent, docs, doc_id, text)) if apart.n_rows else links


def unsettled(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with the bucket's largest and the counts."""
    part_of = components(links)
    named = shared.join(part_of, shared["rep"] == part_of["id"], "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    named = compact(named, "named")
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n_of"))
    mixed = sizes.groupBy("key").agg(
        F.count("*").alias("parts"), F.max_by("component", F.struct("n_of", "component")).alias("main"), F.max("n_of").alias("n_main"), F.sum("n_of").alias("m")
    ).where("parts > 1")
    mixed = compact(mixed.select("key", "main", "n_main", (F.col("m") - F.col("n_main")).alias("n_rest")), "mixed")
    return compact(named.join(mixed, "key"), "apart")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate is not clearly too low."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, runs in centred(batches):
            m, same = rows["n"].to_numpy(), np.zeros(len(rows))
            n = np.zeros(len(rows), dtype=np.int64)
            y = np.frombuffer(b"".join(rows["data"]), dtype=np.uint16).reshape(-1, BUCKETS)
            for of, x, s, e in runs:
                n[s:e] = of
                same[s:e] = (np.frombuffer(x, dtype=np.uint16) == y[s:e]).mean(1)
            ok = (n > 0) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            ok[ok] = likely(estimate(same[ok], n[ok], m[ok]), n[ok], m[ok], percent)
            yield rows.loc[ok, ["a", "b"]]

    carried = classes.select(F.col("rep").alias("id"), "n", F.col("regs").alias("data"))
    return stars(pairs, carried).mapInPandas(run, "a long, b long")


def whole_groups(batches: Iterator[pd.DataFrame], of: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut so that no group is split; memory holds a batch and a group."""
    wait = None
    for b in batches:
        b = b if wait is None else pd.concat([wait, b], ignore_index=True)
        if len(b):
            last = (b[of] == b[of].iloc[-1]).all(axis=1)
            wait = b[last]
            if not last.all():
                yield b[~last].reset_index(drop=True)
    if wait is not None and len(wait):
        yield wait.reset_index(drop=True)


GROUP = ["key", "lo", "hi"]
GROUP_SHAPE = "key long, lo int, hi int, band int, block int, rep long, component long, n long, regs binary"


def plausible_pairs(b: pd.DataFrame, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of b (whole groups): its rows first to last, and the pairs of rows (i, j) of different
    components with their estimates, where they aren't clearly too low. A pair counts in the
    first band that it shares, so no other group has it."""
    key, lo, hi, band, block, component, n = (b[c].to_numpy() for c in ("key", "lo", "hi", "band", "block", "component", "n"))
    regs = np.frombuffer(b"".join(b["regs"]), dtype=np.uint16).reshape(len(b), BUCKETS)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
    for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
        if lo[s] == hi[s]:
            i, j = np.triu_indices(e - s, 1)
        else:
            first = block[s:e] == lo[s]
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij"))
        i, j = i + s, j + s
        ok = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        if len(i):
            same = regs[i] == regs[j]
            near = estimate(same.mean(1), n[i], n[j])
            ok = likely(near, n[i], n[j], percent) & (same.reshape(len(i), -1, BAND).all(2).argmax(1) == band[s])
            if ok.any():
                yield s, e, i[ok], j[ok], near[ok]


def cross_links(apart: DataFrame, classes: DataFrame, size: int, percent: int, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between different components of a bucket. A bucket's members are numbered into blocks
    by hash, those of its largest component apart, as they needn't meet each other; each pair of blocks is
    a group. Groups are read twice: without sets, to see who has a plausible partner in them, and
    then, those only, with their sets. Pairs are compared where both stand, likeliest first, and only
    while their components are still apart, so no list of pairs is made."""
    spark = docs.sparkSession
    rest_blocks, main_blocks = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("n_rest", "n_main"))
    is_main = F.col("component") == F.col("main")
    seat = F.xxhash64("rep")
    own = F.when(is_main, F.col("rest_blocks") + F.pmod(seat, F.col("main_blocks"))).otherwise(F.pmod(seat, F.col("rest_blocks"))).cast("int")
    placed = apart.withColumn("rest_blocks", rest_blocks).withColumn("main_blocks", main_blocks)
    placed = placed.select("key", "band", "rep", "component", own.alias("block"), F.when(is_main, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks")).alias("others"))
    with_regs = compact(placed.join(classes.select(F.col("id").alias("rep"), "n", "regs"), "rep"), "regs", WIDE)
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi"))))
    dealt = with_regs.select("*", other.alias("at")).select(
        "key", F.col("at.lo").cast("int").alias("lo"), F.col("at.hi").cast("int").alias("hi"), "band", "block", "rep", "component", "n", "regs"
    )
    parts = shuffle_partitions(spark)

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, GROUP):
            rows = [np.union1d(i, j) for _, _, i, j, _ in plausible_pairs(b, percent)]
            if rows:
                yield b.iloc[np.unique(np.concatenate(rows))]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, GROUP):
            rep, component = b["rep"].to_numpy(), b["component"].to_numpy()
            out = []
            for s, e, i, j, near in plausible_pairs(b, percent):
                sets = {r: np.frombuffer(b["set"].iat[r], dtype=np.uint64) for r in np.union1d(i, j)}
                at: dict[int, int] = {}

                def find(c: int, at=at) -> int:
                    while c in at:
                        c = at[c]
                    return c

                for k in np.argsort(-near, kind="stable"):
                    x, y = find(component[i[k]]), find(component[j[k]])
                    if x != y and similar(sets[i[k]], sets[j[k]], percent):
                        at[max(x, y)] = min(x, y)
                        out.append((min(rep[i[k]], rep[j[k]]), max(rep[i[k]], rep[j[k]])))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    flagged = dealt.repartition(parts, *GROUP).sortWithinPartitions(*GROUP).mapInPandas(flag, GROUP_SHAPE)
    flagged = compact(flagged, "flagged", WIDE)
    full = full_sets(docs, flagged.select(F.col("rep").alias("id")), classes, size, doc_id, text)
    again = flagged.join(full.withColumnRenamed("id", "rep"), "rep").select(*flagged.columns, "set")
    out = compact(again.repartition(parts, *GROUP).sortWithinPartitions(*GROUP).mapInPandas(join, "a long, b long").distinct(), "more")
    drop(with_regs, flagged, full)
    return out
