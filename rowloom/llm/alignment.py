"""Alignment of two tokenizers by labels of bytes.

Each text is encoded by a byte-level BPE (A: a space and the text) and by a SentencePiece model (B: the text, before
which it puts a space itself), both without special tokens. Every byte of the two gets a label: nothing ends
there (0), a token of A (1), of B (2), or both (3). A regular expression scans the labels and takes spans up to each 3;
a span's numbers of 1 and 2, and its closing 3, say how many tokens of A and of B make up the group. Labels 0 count for nothing
and are taken out before the scan. A group's last tokens end together, and only they: a link for each group.

How often each id pair is linked is counted over all texts. Texts become blocks of some ``BLOCK_BYTES``, written once
with each document's results, the block's distinct pairs (once each, with their number) and each link as a place among them.
Pairs of all blocks are added up, joined with the highest count of their B id (one row an id: bounded by the model's
vocabulary, and broadcast for that reason), and told to each block that has them. A frequent pair is one row a block, so
no key is hot however often it is linked. Each block then sums the counts of its documents' links.

Defined cases: null and empty texts, and those that either tokenizer doesn't give back byte for byte (a text that holds
U+2581, for one), have no tokens: zeros and an empty string; texts of any length are aligned whole (a longer one makes a
block of its own); repeated rows count each by itself; equally frequent partners of a B id are all its best; an empty
table gives an empty result; other columns are not read. A null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, file_bytes
from .common import materialise
from .lm_interpolation import planes, unplanes
from .sentencepiece_table import MARK, model_bytes

BLOCK_BYTES = 4 << 20
#: How blocks are written and read back: a row is some megabytes, so sizes are looked at with every row. By default a
#: writer holds 100 rows before it looks, and a reader takes up to 4096 rows of a row group at once.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
SPAN = re.compile(rb"([\x01\x02]*)\x03")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
A_BITS = 32
PAIR_BITS = 31


def piece_bytes(sp) -> list[bytes]:
    """What each piece of a SentencePiece model stands for in UTF-8."""
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        one = BYTE_PIECE.fullmatch(piece) if sp.is_byte(i) else None
        out.append(bytes([int(one[1], 16)]) if one else piece.replace(MARK, " ").encode())
    return out


class SpanCounts(dict):
    """Tokens of A and B (in one number) that a span's labels and its closing 3 end."""

    def __missing__(self, span: bytes) -> int:
        n = (span.count(1) + 1) << PAIR_BITS | span.count(2) + 1
        if len(span) < 16:  # so that there are few to keep
            self[span] = n
        return n


@dataclass
class Aligned:
    """A text's tokens, and how many of each tokenizer make up its groups."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B that end together: the last ones of each group."""
        return self.a[np.cumsum(self.in_a) - 1], self.b[np.cumsum(self.in_b) - 1]

    def groups(self) -> list[tuple[list[int], list[int]]]:
        a, b = np.split(self.a, np.cumsum(self.in_a)[:-1]), np.split(self.b, np.cumsum(self.in_b)[:-1])
        return [(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)] if len(self.a) else []


NOTHING = Aligned(*[np.zeros(0, dtype=np.int64)] * 4)


class Aligner:
    """Holds the two tokenizers of a task."""

    def __init__(self, bpe: ByteBpe, model: bytes):
        import sentencepiece

        self.bpe, self.pieces = bpe, sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes, self.b_bytes = bpe.tokens, piece_bytes(self.pieces)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.counted = SpanCounts()

    @cached_property
    def names(self) -> list[str]:
        """Ids as text with what follows them: "," or "|" for A, then "," or ";" for B."""
        return [f"{i}{c}" for size, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(size) for c in ends]

    def align(self, text: str | None) -> Aligned:
        if not text:
            return NOTHING
        a_ids, b_ids = self.bpe.encode(" " + text), self.pieces.encode(text)
        whole = (" " + text).encode()
        # A byte-level tokenizer without a normaliser gives back every byte; others are asked.
        if not self.bpe.alike and b"".join(map(self.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
            return NOTHING
        a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        labels = np.zeros(len(whole), dtype=np.uint8)
        labels[np.cumsum(self.a_sizes[a]) - 1] = 1
        labels[np.cumsum(self.b_sizes[b]) - 1] |= 2
        spans = SPAN.findall(labels.tobytes().translate(None, b"\0"))
        counts = np.fromiter(map(self.counted.__getitem__, spans), dtype=np.int64, count=len(spans))
        in_a, in_b = counts >> PAIR_BITS, counts & (1 << PAIR_BITS) - 1
        return Aligned(a, b, in_a, in_b)

    def listed(self, x: Aligned) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``."""
        if not len(x.a):
            return ""
        n = len(x.a) + len(x.b)
        out = np.empty(n, dtype=np.int64)
        # A token's place: behind its group's earlier tokens of A, and all tokens of both in earlier groups.
        end_a, end_b = np.cumsum(x.in_a), np.cumsum(x.in_b)
        place_a = np.arange(len(x.a)) + np.repeat(end_b - x.in_b, x.in_a)
        place_b = np.arange(len(x.b)) + np.repeat(end_a, x.in_b)
        last_a, last_b = np.zeros(len(x.a), dtype=np.int64), np.zeros(len(x.b), dtype=np.int64)
        last_a[end_a - 1] = 1
        last_b[end_b - 1] = 1
        out[place_a] = 2 * x.a + last_a
        out[place_b] = 2 * (len(self.a_bytes) + x.b) + last_b
        return "".join(map(self.names.__getitem__, out.tolist()))[:-1]


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, groups array<struct<a array<int>, b array<int>>> of each row, in the text's order."""
    a_file, b_file = file_bytes(a_path), model_bytes(b_path)
    probed = ByteBpe(a_file).probed()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(ByteBpe(a_file, probed), b_file)
        for batch in batches:
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):  # a text's groups at a time
                made = [{"a": a, "b": b} for a, b in aligner.align(t).groups()]
                yield pd.DataFrame({"doc_id": [d], "groups": [made]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")


BLOCK_SHAPE = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups_sha256 array<string>, links binary, pair_a binary, pair_b binary, pair_n binary"


class _Block:
    def __init__(self):
        self.rows: list[tuple] = []
        self.a, self.b, self.size = [], [], 0

    def add(self, doc_id, text: str | None, aligner: Aligner) -> None:
        x = aligner.align(text)
        a, b = x.links() if len(x.a) else (x.a, x.b)
        listed = aligner.listed(x)
        self.rows.append((doc_id, len(x.a), len(x.b), len(a), hashlib.sha256(listed.encode()).hexdigest() if listed else ""))
        self.a.append(a.astype(np.int32))
        self.b.append(b.astype(np.int32))
        self.size += len(text) if text else 1

    def row(self, number: int) -> pd.DataFrame:
        code = np.concatenate(self.b).astype(np.int64) << A_BITS | np.concatenate(self.a)
        at, pairs = pd.factorize(code)
        n = np.bincount(at, minlength=len(pairs))
        order = np.argsort(-n, kind="stable")  # frequent pairs get small places, which compress
        place = np.empty(len(pairs), dtype=np.uint32)
        place[order] = np.arange(len(pairs), dtype=np.uint32)
        pairs, n = pairs[order], n[order]
        listed = [list(c) for c in zip(*self.rows, strict=True)]
        numbers = [planes(x) for x in (place[at], (pairs & (2**A_BITS - 1)).astype(np.uint32), (pairs >> A_BITS).astype(np.uint32), n.astype(np.uint32))]
        return pd.DataFrame([[number, *listed, *numbers]], columns=[c.split()[0] for c in BLOCK_SHAPE.split(", ")])


def blocks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    a_file, b_file = file_bytes(a_path), model_bytes(b_path)
    probed = ByteBpe(a_file).probed()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(ByteBpe(a_file, probed), b_file)
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for d, t in zip(batch["doc_id"].astype("object"), batch["text"], strict=True):
                block.add(None if pd.isna(d) else int(d), t, aligner)
                if block.size >= BLOCK_BYTES:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.rows:
            yield block.row(number)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, BLOCK_SHAPE)


def asked(made: DataFrame) -> DataFrame:
    """block, place, a, b, n: the distinct pairs of each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a, b, n = (unplanes(x, np.uint32).astype(np.int64) for x in (r.pair_a, r.pair_b, r.pair_n))
                yield pd.DataFrame({"block": r.block, "place": np.arange(len(a)), "a": a, "b": b, "n": n})

    return made.select("block", "pair_a", "pair_b", "pair_n").mapInPandas(run, "block long, place int, a int, b int, n long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count, best: how often each id pair is linked in all texts, and whether none of the B id's is more often."""
    counts = materialise(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs", "zstd")
    highest = counts.groupBy("b").agg(F.max("count").alias("_most"))  # at most a row for each id of B's vocabulary
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    made = materialise(blocks(docs, a_path, b_path, doc_id, text), "aligned", "zstd", **ROW_GROUPS)
    pairs = asked(made)
    told = pairs.select("block", "place", "a", "b").join(link_counts(pairs), ["a", "b"]).select("block", "place", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(key, b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({c: [] for c in names})
        b = b.iloc[0]
        count, best = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
        count[t["place"]] = t["count"]
        best[t["place"]] = t["best"]
        links = unplanes(b["links"], np.uint32)
        ends = np.cumsum(np.asarray(b["n_links"], dtype=np.int64))
        of_documents = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[links])])[np.concatenate([[0], ends])])
        out = pd.DataFrame({c: b[c] for c in ("n_a", "n_b", "n_links", "groups_sha256")})
        out["doc_id"] = pd.array(list(b["doc_ids"]), dtype="Int64")
        return out.assign(n_groups=out["n_links"], n_best=of_documents(best), count_sum=of_documents(count))[names]

    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    shown = made.select("block", "doc_ids", "n_a", "n_b", "n_links", "groups_sha256", "links")
    return shown.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(finish, shape)
