"""Text quality by a factorisation machine.

Inputs of a text: hashed distinct words (scaled so that they weigh as one), and statistics of
its structure and the n_chars metadata, each as one of ``BINS`` quantile bins. The machine adds a
weight for each input and, for each pair of inputs, the product of their low-rank vectors; with

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

a text is scored in time linear in its inputs. Weights are learned in numpy by minibatch Adagrad.

Fitting reads a bounded sample, ``max_labelled`` labelled documents (a parameter, 8000 by default; the first by a hash of
their ids, and of the texts of an id that repeats, the least); scoring reads every whole text once, with a model of fixed size.

Defined cases: null and empty texts have zero statistics and no words, and get the score those bins
have; a null n_chars counts as 0; repeated rows score equally; of labels of one id the least counts, and ids of equal hash
go into the sample by their number; labels that are null or have
no document are not learned from; without labels of both kinds every score is the share of
label 1 (0.5 without labels); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 8000
WORD_BITS, RANK, BINS = 14, 8, 10
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
SPACE = bytes([32, *range(9, 14)])
HIGH = bytes(range(128, 256))
MARKS = b".,;:!?'\"()-"
STATS = 15


def statistics(text: str | None, n_chars: int, ws: list[bytes] | None = None) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    ws = raw.split() if ws is None else ws
    size, n = max(1, len(raw)), max(1, len(ws))
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    upper, lower, digit, space, high, mark = (left(x) for x in (UPPER, LOWER, DIGIT, SPACE, HIGH, MARKS))
    lines = raw.split(b"\n")
    distinct = len(set(ws))
    same = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    return [
        np.log1p(len(ws)), len(raw) / n, upper / max(1, upper + lower), digit / size, mark / size,
        (len(raw) - upper - lower - digit - space - high - mark) / size, high / size, distinct / n, same / n, raw.count(b"|") / n,
        len(set(lines)) / len(lines), len(ws) / len(lines), raw.count(b".") / n, raw.count(b"!") / n, np.log1p(max(0, n_chars)),
    ]


def word_inputs(ws: list[bytes], table: dict[bytes, int]) -> list[int]:
    out = []
    for w in set(ws):
        i = table.get(w)
        if i is None:
            if len(table) > 400_000:
                table.clear()
            i = zlib.crc32(w.lower()) & ((1 << WORD_BITS) - 1)
            if len(w) <= 64:
                table[w] = i
        out.append(i)
    return out


class Machine:
    """bias + linear + pairs; inputs [0, 2**WORD_BITS) are words, then BINS for each statistic."""

    def __init__(self, seed: int = 5):
        n = (1 << WORD_BITS) + STATS * BINS
        self.w, self.bias = np.zeros(n), 0.0
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, RANK))
        self.edges = np.zeros((STATS, BINS - 1))

    def inputs(self, word_ids, stats) -> tuple[np.ndarray, np.ndarray]:
        bins = [(1 << WORD_BITS) + k * BINS + int(np.searchsorted(self.edges[k], s, side="right")) for k, s in enumerate(stats)]
        ids = np.concatenate([np.asarray(word_ids, dtype=np.int64), np.array(bins, dtype=np.int64)])
        x = np.ones(len(ids))
        x[: len(word_ids)] = 1 / np.sqrt(max(1, len(word_ids)))
        return ids, x

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        return self.bias + float(self.w[ids] @ x) + 0.5 * float((vx.sum(0) ** 2).sum() - (vx * vx).sum())

    def fit(self, words: list[np.ndarray], stats: np.ndarray, y: np.ndarray, epochs: int = 15, batch: int = 256, rate: float = 0.1, decay: float = 2e-4, seed: int = 6):
        self.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        rng = np.random.default_rng(seed)
        rows = [self.inputs(w, s) for w, s in zip(words, stats, strict=True)]
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        gw, gv, gb = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                ids, x = (np.concatenate([rows[i][k] for i in some]) for k in (0, 1))
                row = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
                vx = self.v[ids] * x[:, None]
                s = np.stack([np.bincount(row, weights=vx[:, f], minlength=len(some)) for f in range(RANK)], axis=1)
                q = np.bincount(row, weights=(vx * vx).sum(1), minlength=len(some))
                m = self.bias + np.bincount(row, weights=self.w[ids] * x, minlength=len(some)) + 0.5 * ((s * s).sum(1) - q)
                g = (1 / (1 + np.exp(-np.clip(m, -50, 50))) - y[some]) / len(some)
                u, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, weights=g[row] * x) + decay * self.w[u]
                dv = np.stack([np.bincount(back, weights=g[row] * x * (s[row, f] - vx[:, f])) for f in range(RANK)], axis=1) + decay * self.v[u]
                gw[u] += dw * dw
                gv[u] += dv * dv
                gb += g.sum() ** 2
                self.w[u] -= rate * dw / np.sqrt(gw[u])
                self.v[u] -= rate * 0.3 * dv / np.sqrt(gv[u])
                self.bias -= rate * g.sum() / np.sqrt(gb)
        return self


def _columns(docs: DataFrame, doc_id: str, text: str, n_chars: str | None) -> DataFrame:
    meta = F.col(n_chars).cast("long") if n_chars else F.lit(None).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(meta, F.lit(0)).alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, is_train: Column, doc_id="doc_id", text="text", n_chars: str | None = "n_chars", max_labelled: int = MAX_LABELLED) -> tuple[Machine | None, float]:
    """The fitted machine, and the share of good documents among those it was fitted to. The driver holds the inputs of
    ``max_labelled`` documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(is_train).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64(F.lit("quality"), F.col("doc_id")), "doc_id").limit(max_labelled).collect()
    if not some:
        return None, 0.5
    # At most max_labelled rows.
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["quality"])) for r in some], "doc_id long, quality int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, y, t, n in zip(b["doc_id"], b["quality"], b["text"], b["n_chars"], strict=True):
                ws = t.encode("utf-8", "surrogatepass").split() if t else []
                rows.append((d, y, np.array(word_inputs(ws, {}), dtype=np.int16).tobytes(), statistics(t, n, ws)))
            yield pd.DataFrame(rows, columns=["doc_id", "quality", "w", "s"])

    rows = _columns(docs, doc_id, text, n_chars).join(F.broadcast(picked), "doc_id")
    # One row an id: that of the least text.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by(F.struct("text", "n_chars"), F.struct("text", "n_chars")).alias("row")).select("doc_id", "quality", "row.text", "row.n_chars")
    got = rows.mapInPandas(run, "doc_id long, quality int, w binary, s array<double>").toPandas().sort_values("doc_id")
    y = got["quality"].to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return None, float(y.mean()) if len(y) else 0.5
    machine = Machine().fit([np.sort(np.frombuffer(w, dtype=np.int16)) for w in got["w"]], np.array(got["s"].tolist()), y)
    return machine, float(y.mean())


def score(docs: DataFrame, model: tuple[Machine | None, float], doc_id="doc_id", text="text", n_chars: str | None = "n_chars") -> DataFrame:
    machine, share = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[bytes, int] = {}
        for b in batches:
            out = np.full(len(b), share)
            if machine is not None:
                for i, (t, n) in enumerate(zip(b["text"], b["n_chars"], strict=True)):
                    ws = t.encode("utf-8", "surrogatepass").split() if t else []
                    m = machine.margin(*machine.inputs(np.sort(np.array(word_inputs(ws, table), dtype=np.int64)), statistics(t, n, ws)))
                    out[i] = 1 / (1 + np.exp(-np.clip(m, -50, 50)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": out})

    return _columns(docs, doc_id, text, n_chars).mapInPandas(run, "doc_id long, score double")
