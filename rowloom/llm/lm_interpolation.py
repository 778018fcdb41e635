"""Language-model scores by deleted interpolation.

    P_1(w)   = m c(w)/N + (1 - m) / (V + 1)
    P_k(w|h) = l_k[b] c(hw)/c(h) + (1 - l_k[b]) P_{k-1}(w|h')        b = floor(log2 c(h))

Maximum-likelihood estimates of each order are mixed with the next lower one, with a weight for each
bucket of the context's frequency, down to a uniform share for V known words and one unknown.
Weights are learned by expectation-maximisation on held-out counts: a slice of the training
documents (``SLICE_OF`` parts) is taken out of the counts, and the weights that make it likeliest
are used with the counts of all training documents.

Counts grow with the corpus, so they are never collected or broadcast. Texts become blocks of some
``BLOCK_BYTES`` with the distinct n-grams of each; a block asks for its n-grams, once each, in
sorted key ranges; whoever owns a range adds up what all blocks count and answers each block in its own
order; blocks then score their documents in numpy. Frequent words cost one key a block, so no key is
hot. What reaches the driver is sums, and a histogram of quantised estimates of bounded size.

A corpus of many blocks has more ranges than a block can fill (``RANGES``). Then blocks ask in at most so many
coarse ranges, and blocks of one group are merged there: their distinct keys, with their counts added, ask
again in the fine ranges in the place of all of them, and what they are told goes back through the group to each
block. A group holds as many blocks as make its merged keys fill the fine ranges, so rows stay long at any size.

N-grams are identified by 64-bit hashes. An ``end`` closes each text and is the context of its first word.

Defined cases: null and empty texts consist of the end alone; texts of any length are scored whole (a
longer one makes a block of its own); repeated rows count and score each by itself; a null id counts
as the empty text in the split; without training documents all words are unknown and the model is
uniform; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, words
from .hyperminhash import mix64

BLOCK_BYTES = 14 << 20
#: Training documents whose crc32 modulo this is 0 are held out for the weights.
SLICE_OF = 11
KEYS_OF_RANGE = 1_500_000
RANGES = 512  # that a block asks in, at most: it has some thousand keys for each
GROUP_BLOCKS = 1024  # blocks whose keys of a coarse range are merged: some two million
STEPS = 8  # quantisation steps for each factor of two, in the histogram for the weights
FREQUENCIES = 40
C = np.uint64(0x9E3779B97F4A7C15)

BLOCK_SHAPE = "block long, role int, doc_ids array<long>, lens array<int>, ranks binary, words binary, tokens long"


def planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that the many zeros stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


class _Block:
    def __init__(self):
        self.rank: dict[bytes, int] = {b"": 0}  # the end
        self.ids, self.lens, self.ranks, self.size = [], [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        rank = self.rank
        ws = words(text)
        self.ranks.append(np.array([rank.setdefault(w, len(rank)) for w in ws] + [0], dtype=np.uint32))
        self.ids.append(doc_id)
        self.lens.append(len(ws) + 1)
        self.size += len(text) if text else 1


def blocks(docs: DataFrame, role: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """role: 0 only scored, 1 counted, 2 counted and held out for the weights. Blocks have one role each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        open_: dict[int, _Block] = {}
        made = 0
        part = TaskContext.get().partitionId()

        def close(r: int) -> pd.DataFrame:
            nonlocal made
            b = open_.pop(r)
            keys = np.array([xxhash.xxh3_64_intdigest(w) for w in b.rank], dtype=np.uint64)
            ranks = np.concatenate(b.ranks)
            made += 1
            return pd.DataFrame({"block": [part << 32 | made], "role": [r], "doc_ids": [b.ids], "lens": [b.lens], "ranks": [planes(ranks)], "words": [keys.tobytes()], "tokens": [len(ranks)]})

        for batch in batches:
            for d, r, t in zip(batch["doc_id"].astype("object"), batch["role"], batch["text"], strict=True):
                b = open_.setdefault(r, _Block())
                b.add(None if pd.isna(d) else int(d), t)
                if b.size >= BLOCK_BYTES:
                    yield close(r)
        for r in sorted(open_):
            yield close(r)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), role.cast("int").alias("role"), F.col(text).alias("text"))
    return rows.mapInPandas(run, BLOCK_SHAPE)


class Grams:
    """Distinct n-grams of a block by order: keys, and for each token the index of the n-gram it ends."""

    def __init__(self, ranks: bytes, keys: bytes, lens, order: int):
        rank = unplanes(ranks, np.uint32).astype(np.int64)
        words_ = np.frombuffer(keys, dtype=np.uint64)
        lens = np.asarray(lens, dtype=np.int64)
        self.first = np.zeros(len(rank), dtype=bool)
        self.first[np.concatenate([[0], np.cumsum(lens)[:-1]])] = True
        self.keys, self.at, self.context = [words_], [rank], [None]
        previous = rank  # index of the (k-1)-gram that ends at each token
        for k in range(2, order + 1):
            context = np.empty_like(previous)
            context[1:] = previous[:-1]
            # Before a text stand ends: as many as the context takes, kept apart as one more index.
            none = len(self.keys[-1])
            context[self.first] = 0 if k == 2 else none
            code, at = np.unique(context * len(words_) + rank, return_inverse=True)
            lower = self.keys[-1] if k == 2 else np.append(self.keys[-1], np.uint64(k))
            with np.errstate(over="ignore"):
                key = mix64(lower[code // len(words_)] * C + words_[code % len(words_)] + np.uint64(k))
            self.keys.append(key)
            self.at.append(at)
            self.context.append(context)
            previous = at


def _bounds(sorted_keys: np.ndarray, ranges: int) -> np.ndarray:
    own = ((sorted_keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(own, np.arange(ranges + 1, dtype=np.uint64))


ASKED = "gram int, part int, block long, role int, keys binary, n binary, held binary"
TOLD = "block long, gram int, part int, role int, counted binary, held binary, known long"
MERGED = -1  # the role of rows that stand for a group of blocks, with counts of their own


def merged(b: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys of some rows of one range, the place of each row's keys among them, and their counts: of
    training texts, and of the held-out slice."""
    keys = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in b["keys"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(x) for x in keys])
    own = [at[e - len(x) : e] for e, x in zip(ends, keys, strict=True)]
    counted, held = np.zeros(len(distinct), dtype=np.uint64), np.zeros(len(distinct), dtype=np.uint64)
    # A row's keys are distinct, so its counts can be added in place.
    for places, role, n, h in zip(own, b["role"], b["n"], b["held"], strict=True):
        if role == MERGED:
            counted[places] += unplanes(n, np.uint64)
            held[places] += unplanes(h, np.uint64)
        elif role > 0:
            n = unplanes(n, np.uint32).astype(np.uint64)
            counted[places] += n
            if role == 2:
                held[places] += n
    return distinct, own, counted, held


def told_rows(b: pd.DataFrame, own: list[np.ndarray], counted: np.ndarray, held: np.ndarray, known: int) -> pd.DataFrame:
    """Counts for each row in its own order; those of the slice only where they are asked for."""
    slice_ = [planes(held[x]) if role in (2, MERGED) else None for x, role in zip(own, b["role"], strict=True)]
    return pd.DataFrame({"block": b["block"], "gram": b["gram"], "part": b["part"], "role": b["role"], "counted": [planes(counted[x]) for x in own], "held": slice_, "known": np.append(known, np.zeros(len(b) - 1, dtype=np.int64))})


def cut_rows(keys: np.ndarray, bounds: np.ndarray, n: np.ndarray, held: np.ndarray | None, **same) -> pd.DataFrame:
    """Rows of ASKED for sorted keys, one for each range between bounds that has any; parts are numbered from 0."""
    some = np.flatnonzero(np.diff(bounds))
    piece = lambda x, i: x[bounds[i] : bounds[i + 1]]
    made = {"part": some, "keys": [planes(np.diff(piece(keys, i), prepend=np.uint64(0))) for i in some], "n": [planes(piece(n, i)) for i in some], "held": [None if held is None else planes(piece(held, i)) for i in some]}
    return pd.DataFrame(made).assign(**same)[[c.split()[0] for c in ASKED.split(", ")]]


def answer(b: pd.DataFrame) -> pd.DataFrame:
    """Rows of one range: what all of them count together, told to each in its own order."""
    _, own, counted, held = merged(b)
    return told_rows(b, own, counted, held, int((counted > 0).sum()))


def answers(made: DataFrame, order: int) -> DataFrame:
    """For each block, order and key range: counts of its n-grams over all training documents, and over
    the held-out slice, in the order of the keys; ``known`` is the range's number of counted keys, once."""
    spark = made.sparkSession
    total = made.agg(F.sum("tokens")).first()[0] or 0
    fine = max(-(-total // KEYS_OF_RANGE), 4 * shuffle_partitions(spark))
    ranges = min(fine, max(RANGES, 4 * shuffle_partitions(spark)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                g = Grams(b.ranks, b.words, b.lens, order)
                for k in range(order):
                    place = np.argsort(g.keys[k])
                    keys, n = g.keys[k][place], np.bincount(g.at[k], minlength=len(place))[place].astype(np.uint32)
                    yield cut_rows(keys, _bounds(keys, ranges), n, None, gram=k + 1, block=b.block, role=b.role)

    asked = made.select("block", "role", "lens", "ranks", "words").mapInPandas(ask, ASKED)
    if ranges == fine:
        return asked.groupBy("gram", "part").applyInPandas(answer, TOLD)
    # Two levels: groups of blocks ask for all of theirs.
    groups = -(-made.count() // GROUP_BLOCKS)
    asked = materialise(asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))), "asked", "zstd")
    within = -(-fine // ranges)  # fine ranges in a coarse one
    grouped = ["gram", "part", "group"]

    def merge(key, b: pd.DataFrame) -> pd.DataFrame:
        distinct, _, counted, held = merged(b)
        out = cut_rows(distinct, _bounds_within(distinct, ranges, within), counted, held, gram=key[0], block=key[2], role=MERGED)
        return out.assign(coarse=key[1])

    asking = asked.groupBy(*grouped).applyInPandas(merge, ASKED + ", coarse int")

    def answer_groups(b: pd.DataFrame) -> pd.DataFrame:
        return answer(b).assign(coarse=b["coarse"].to_numpy())

    told = asking.groupBy("gram", "coarse", "part").applyInPandas(answer_groups, TOLD + ", coarse int")
    told = materialise(told.select(F.col("gram").alias("of_gram"), F.col("coarse").alias("of_part"), F.col("block").alias("of_group"), F.col("part").alias("at"), "counted", "held", "known"), "told", "zstd")

    def give_back(key, b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in TOLD.split(", ")})
        t = t.sort_values("at")
        counted, held = (np.concatenate([unplanes(x, np.uint64) for x in t[c]]) for c in ("counted", "held"))
        _, own, _, _ = merged(b)
        return told_rows(b, own, counted, held, int(t["known"].sum()))

    return asked.groupBy(*grouped).cogroup(told.groupBy("of_gram", "of_part", "of_group")).applyInPandas(give_back, TOLD)


def _bounds_within(sorted_keys: np.ndarray, ranges: int, within: int) -> np.ndarray:
    """Cuts of one coarse range's keys into its fine ranges."""
    high = (sorted_keys >> np.uint64(32)) * np.uint64(ranges)
    own = ((high & np.uint64(0xFFFFFFFF)) * np.uint64(within)) >> np.uint64(32)
    return np.searchsorted(own, np.arange(within + 1, dtype=np.uint64))


def counts_of(g: Grams, told: pd.DataFrame, column: str, order: int) -> list[np.ndarray]:
    out = []
    for k in range(order):
        mine = told[told["gram"] == k + 1].sort_values("part")
        in_order = np.concatenate([unplanes(x, np.uint64) for x in mine[column]])
        n = np.empty(len(in_order), dtype=np.float64)
        n[np.argsort(g.keys[k])] = in_order
        out.append(n)
    return out


def estimates(g: Grams, counts: list[np.ndarray], total: float, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(maximum-likelihood estimate, context count) of each token, by order."""
    out = [(counts[0][g.at[0]] / max(total, 1.0), np.full(len(g.at[0]), total))]
    for k in range(1, order):
        lower = counts[k - 1] if k == 1 else np.append(counts[k - 1], counts[0][0])  # texts begin as often as they end
        n = lower[g.context[k]]
        out.append((counts[k][g.at[k]] / np.maximum(n, 1), n))
    return out


def frequency(n: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for none, else 1 + floor(log2)."""
    return np.where(n > 0, np.minimum(np.floor(np.log2(np.maximum(n, 1))) + 1, FREQUENCIES - 1), 0).astype(np.int64)


def _em(ratio: np.ndarray, weight: np.ndarray, rounds: int = 200) -> float:
    """Mixture weight of an estimate that is ratio times the lower one, on weighted held-out tokens."""
    share = 0.5
    for _ in range(rounds):
        top = share * ratio
        share = float((weight * top / (top + 1 - share)).sum() / weight.sum())
        share = min(max(share, 1e-6), 1 - 1e-6)
    return share


def weights(histogram: list[tuple[tuple[int, ...], tuple[int, ...], int]], order: int) -> list[np.ndarray]:
    """Mixture weights by order and frequency bucket, from (buckets, quantised log ratios to the uniform
    share, tokens) of the held-out slice; orders are learned from the lowest up."""
    out = [np.full(FREQUENCIES, 0.5) for _ in range(order)]
    for w in out[1:]:
        w[0] = 0.0
    if not histogram:
        return out
    b, q, n = (np.array(x) for x in zip(*histogram, strict=True))
    p = np.where(q > -(10**6), 2.0 ** (np.clip(q, -8000, 8000) / STEPS), 0.0)
    lower = np.ones(len(n))
    for k in range(order):
        last = None
        for f in range(1, FREQUENCIES):
            here = (b[:, k] == f) if k else np.ones(len(n), dtype=bool)
            if here.any():
                last = _em(p[here, k] / lower[here], n[here].astype(float))
            if last is not None:
                out[k][f] = last
        seen = np.flatnonzero(np.bincount(b[b[:, k] > 0, k], minlength=FREQUENCIES)) if k else np.arange(1)
        if len(seen) and k:
            out[k][1 : seen[0]] = out[k][seen[0]]
        share = out[k][b[:, k]] if k else np.full(len(n), out[0][1])
        out[0][:] = out[0][1]
        lower = share * p[:, k] + (1 - share) * lower
    return out


def mixture(est, learned: list[np.ndarray], vocabulary: int, order: int) -> np.ndarray:
    p = np.full(len(est[0][0]), 1.0 / (vocabulary + 1))
    for k in range(order):
        ml, n = est[k]
        share = learned[k][frequency(n)] if k else (learned[0][1] if n.size and n[0] > 0 else 0.0)
        p = share * ml + (1 - share) * p
    return p


def score(docs: DataFrame, is_train: Column, order: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    if not 1 <= order <= 3:
        raise ValueError("order is 1, 2 or 3")
    held = F.crc32(F.concat(F.lit("slice"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")) % SLICE_OF == 0
    role = F.when(~is_train, 0).when(held, 2).otherwise(1)
    made = materialise(blocks(docs, role, doc_id, text), "blocks", "zstd")
    told = materialise(answers(made, order), "answers", "zstd")
    sums = made.agg(F.sum(F.when(F.col("role") > 0, F.col("tokens"))).alias("n"), F.sum(F.when(F.col("role") == 2, F.col("tokens"))).alias("held")).first()
    total, held_total = int(sums["n"] or 0), int(sums["held"] or 0)
    vocabulary = int(told.where("gram = 1").agg(F.sum("known")).first()[0] or 0)

    def quantised(key, b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        shape = ["code", "n"]
        if not len(b) or not len(t):
            return pd.DataFrame({"code": pd.Series(dtype="object"), "n": pd.Series(dtype="int64")})[shape]
        b = b.iloc[0]
        g = Grams(b["ranks"], b["words"], b["lens"], order)
        rest = [a - h for a, h in zip(counts_of(g, t, "counted", order), counts_of(g, t, "held", order), strict=True)]
        est = estimates(g, rest, float(total - held_total), order)
        columns = [frequency(n) for _, n in est]
        with np.errstate(divide="ignore"):
            columns += [np.where(p > 0, np.round(np.log2(p * (vocabulary + 1)) * STEPS), -(10**7)).astype(np.int64) for p, _ in est]
        rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return pd.DataFrame({"code": [",".join(map(str, r)) for r in rows.tolist()], "n": n})[shape]

    held_blocks, held_told = made.where("role = 2"), told.where("role = 2")
    bins = held_blocks.groupBy("block").cogroup(held_told.groupBy("block")).applyInPandas(quantised, "code string, n long")
    # Buckets and steps are bounded, so these rows are, however large the corpus.
    got = bins.groupBy("code").agg(F.sum("n").alias("n")).collect()
    table = sorted((tuple(map(int, r["code"].split(","))), r["n"]) for r in got)
    learned = weights([(c[:order], c[order:], n) for c, n in table], order)

    def finish(key, b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(b):
            return pd.DataFrame({c: [] for c in names})
        b = b.iloc[0]
        g = Grams(b["ranks"], b["words"], b["lens"], order)
        counts = counts_of(g, t, "counted", order)
        p = mixture(estimates(g, counts, float(total), order), learned, vocabulary, order)
        own = counts[0][g.at[0]]
        base = np.log10((own + 1) / (total + vocabulary + 1))
        starts = np.concatenate([[0], np.cumsum(b["lens"])[:-1]]).astype(np.int64)
        add = lambda x: np.add.reduceat(x, starts)
        out = pd.DataFrame({"held_out": b["role"] == 0, "n_tokens": np.asarray(b["lens"], dtype=np.int64), "n_known": add((own > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(np.log10(p))})
        out["doc_id"] = pd.array(list(b["doc_ids"]), dtype="Int64")
        return out[names]

    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    counts_told = told.select("block", "gram", "part", "counted")
    return made.groupBy("block").cogroup(counts_told.groupBy("block")).applyInPandas(finish, shape)
