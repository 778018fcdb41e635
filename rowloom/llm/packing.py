"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

``pieces`` encodes each document (byte-level ids, then an end id) and cuts it into pieces: as many of a whole
sequence's length as it fills, and a rest. Every ``FILLER_EVERY``-th document, by its id's crc32, has its rest cut
into powers of two, so that there are small pieces for the gaps that rests leave.

``pack`` counts pieces by length (as many numbers as a sequence has positions), and places the counts on the
driver, longest lengths first: pieces of a length go to the pattern that is filled least and has room, whose count
of packs goes down as that of the pattern with one more piece goes up. New packs are opened only when none has
room, and take as many of the length as they hold. A pattern's packs are alike, so the work depends on the
number of patterns, not of pieces. Patterns name no piece: a piece is found by its rank among those of
its length. Ranks are counted in buckets of rows that are equally large whatever the lengths, and joined to the
counts before them; a sorted table of the patterns' places then gives each rank its sequence and offset.

The table of places has at most ``2 * capacity`` patterns of at most ``sqrt(2 * capacity)`` distinct lengths each (some
90 000 rows for 1024), so every task can hold it. Ids move with their pieces only where ``pack`` is given them.

Defined cases: null and empty texts are the end id alone; texts of any length are cut, none is dropped; repeated
rows are packed each by itself; a null id counts as the empty text in the choice of fillers; an empty
table gives an empty result; other columns are not read. Pieces of equal length are told apart by the order of
their rows, so a rerun over files dealt out otherwise may exchange them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, file_bytes
from .common import compact

CAPACITY = 1024
FILLER_EVERY = 8
SLICE = 2_000_000  # ids held at once, or one text's
#: Rows of a length that one bucket is to hold, and the buckets there are at least.
BUCKET_ROWS, BUCKETS = 200_000, 256
RANK_BITS = 50
#: Rows a scratch file, without ids and with them.
NARROW, WIDE = 100_000, 5000


def cut(n: int, capacity: int, filler: bool) -> list[int]:
    """Lengths of the pieces of n ids."""
    rest = n % capacity
    small = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1] if filler else [rest] * (rest > 0)
    return [capacity] * (n // capacity) + small


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit), row (unique) of each piece."""
    file = file_bytes(path)
    probed = ByteBpe(file).probed()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe(file, probed)
        row = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "doc_tokens", "ids", "row"]
        for b in batches:
            rows, held = [], 0
            for d, crc, t in zip(b["doc_id"].astype("object"), b["crc"], b["text"], strict=True):
                ids = np.array([*bpe.encode(t), end], dtype="<u4")
                start, data = 0, ids.tobytes()
                d = None if pd.isna(d) else int(d)
                for length in cut(len(ids), capacity, crc % FILLER_EVERY == 0):
                    rows.append((d, start, length, len(ids), data[4 * start : 4 * (start + length)], row))
                    start, row = start + length, row + 1
                held += len(ids)
                if held > SLICE:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("crc")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), crc, F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, start long, length long, doc_tokens long, ids binary, row long")


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(number of packs, ((length, pieces of it in each pack), ...)) from the numbers of pieces by length."""
    filled: list[deque] = [deque() for _ in range(capacity + 1)]  # [packs, runs] of the patterns by what they hold

    def more(runs: tuple, length: int) -> tuple:
        return (*runs[:-1], (length, runs[-1][1] + 1)) if runs[-1][0] == length else (*runs, (length, 1))

    for length in sorted(counts, reverse=True):
        left, least = counts[length], 1
        while left:
            least = next((f for f in range(least, capacity - length + 1) if filled[f]), None)
            if least is None:  # no room anywhere: new packs, filled with this length
                whole, over = divmod(left, capacity // length)
                for packs, k in ((whole, capacity // length), (1, over)):
                    if packs and k:
                        filled[k * length].append([packs, ((length, k),)])
                break
            pattern = filled[least][0]
            taken = min(left, pattern[0])
            filled[least + length].append([taken, more(pattern[1], length)])
            pattern[0] -= taken
            left -= taken
            if not pattern[0]:
                filled[least].popleft()
    return [(packs, runs) for at in filled for packs, runs in at]


def places(made: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """The patterns' places by length and first rank: key, rank, k, sequence, offset, sorted by key."""
    rows, used, sequence = [], {}, 0
    for packs, runs in made:
        offset = 0
        for length, k in runs:
            rank = used.get(length, 0)
            rows.append((length << RANK_BITS | rank, rank, k, sequence, offset))
            used[length] = rank + packs * k
            offset += length * k
        sequence += packs
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "rank", "k", "sequence", "offset"), table.T.copy(), strict=True))


def ranked(parts: DataFrame, buckets: int) -> DataFrame:
    """With ``rank``, from 0, among the rows of each length: no group is larger than a bucket's share."""
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("row")))
    counts = dealt.groupBy("length", "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    return own.join(starts, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_bucket", "_own", "_before")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``pieces`` (any columns; length and row are read) with sequence_id and offset.

    Rows are written once, as their ranks and their counts must come from the same ones, in as few files as they need:
    an executor forks a helper for each file's mode, which for a moment holds as much memory as itself."""
    parts = compact(parts, "pieces", WIDE if "ids" in parts.columns else NARROW, "zstd")
    # At most as many rows as a sequence has positions.
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    table = places(patterns(counts, capacity))
    longest = max(counts.values(), default=0)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b.pop("rank").to_numpy()
            i = np.searchsorted(table["key"], length << RANK_BITS | rank, side="right") - 1
            pack_, slot = np.divmod(rank - table["rank"][i], table["k"][i])
            yield b.assign(sequence_id=table["sequence"][i] + pack_, offset=table["offset"][i] + slot * length)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    with_rank = ranked(parts, max(BUCKETS, -(-longest // BUCKET_ROWS)))
    return with_rank.select(*parts.columns, "rank").mapInPandas(place, f"{fields}, sequence_id long, offset long")


def padding(total, capacity: int = CAPACITY):
    """Ids added to a sequence of so many: none at a power of two, else what fills it (a Column)."""
    return F.when(F.bit_count(total) == 1, F.lit(0)).otherwise(F.lit(capacity) - total)


def sequences(packed: DataFrame, pad: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids array<int> padded with ``pad``, parts array<struct<doc_id, start, length, offset>>: the packed
    rows brought together, a sequence's at most ``capacity`` pieces in a group. Needs the column ids."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for datas, add in zip(b["_ids"], b["_pad"], strict=True):
                rows.append(np.concatenate([*(np.frombuffer(x, dtype="<u4") for x in datas), np.full(add, pad)]).astype(np.int32))
            yield pd.DataFrame({"sequence_id": b["sequence_id"], "ids": rows, "parts": b["parts"]})

    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n"))
    shape = grouped.select(
        "sequence_id", F.transform("p", lambda x: x["ids"]).alias("_ids"), padding(F.col("n"), capacity).alias("_pad"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("parts"),
    )
    kind = shape.schema["parts"].dataType.simpleString()
    return shape.mapInPandas(join, f"sequence_id long, ids array<int>, parts {kind}")
