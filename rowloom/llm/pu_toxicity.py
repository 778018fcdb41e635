"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; unlabelled text is everything else, toxic texts
among it. A logistic model over hashed words and word beginnings is trained in numpy on the risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

whose second part estimates the risk on non-toxic text without having any; where it turns
negative the model overfits, and the step goes the other way. No label of non-toxic text is used.

The class prior is a parameter, or estimated: unlabelled text passes a threshold at least as often as the toxic
part of it does, so the share of unlabelled texts over a threshold, divided by the share of positives over it,
bounds the prior from above; the least such bound, with its sampling error, is taken (``estimate_prior``). The scores
are log ratios of the features' shares; a positive's come from the positives of the other folds.

How often features occur and which of them are used rests on all training texts; features that a sample of them shows to be
too common (by six deviations) aren't counted in the rest. Prior and weights are fitted
to bounded samples, the first by a hash of their ids: ``max_positive`` and ``max_unlabelled`` documents (parameters;
None takes all, equal texts of features counted once with their number). ``max_features`` bounds the weights
(None: no bound). Scoring reads every whole text once.

Defined cases: null and empty texts get the score of a text without known words; features count
by presence and density, so length alone never makes a text toxic; repeated rows score equally, ties in
choosing features go by their number; labels for ids without a document, null labels and null ids are left out of training;
without any positive all scores are the prior (0 where none is given); where nothing tells positives from other
texts all scores are the prior, but under a half; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: What fit() takes where its caller names no bounds.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4000, 8000, 4096
#: Thresholds that this share of the positives or more passes tell of the prior; shares may be this many deviations off.
PRIOR_SHARE, PRIOR_Z, FOLDS = 0.5, 1.0, 5
HASH_BITS = 22
#: Size of the second sample that rules features out, beside the first one's; features held at once while they are counted.
SECOND, COUNTED_AT_ONCE = 4, 1_000_000
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
BEGINNINGS = (4, 5, 6, 7)
#: A feature counts again when it makes up these shares of a text's words.
DENSITIES = (0.003, 0.007)
LEVELS = 1 + len(DENSITIES)
#: Selected features are in at least so many positives and so many deviations more common there; 5 was
#: best of 3 to 6 with a fifth of the training rows held out from the others.
LEAST_IN, LEAST_Z = 3, 5.0


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, of which the word has to be longer."""
    mask, size = (1 << HASH_BITS) - 1, len(word)
    own = zlib.crc32(word) & mask
    if size <= BEGINNINGS[0]:
        return (own,)
    out, crc, last = [own], 0x51ED, 0
    for n in BEGINNINGS:  # each goes on where the one before ended
        if size <= n:
            break
        crc = zlib.crc32(word[last:n], crc)
        out.append(crc & mask)
        last = n
    return tuple(out)


def counted_words(text: str | None) -> Counter:
    return Counter(LETTERS.findall(text.lower().encode("utf-8", "surrogatepass")) if text else ())


def levels(count: int, total: int) -> int:
    """How many of the densities a feature reaches that count of a text's total words have; densities ascend."""
    reached = 1
    for d in DENSITIES:
        if count < d * total:
            break
        reached += 1
    return reached


def text_features(text: str | None) -> list[int]:
    """Ids of the text's features: each word or beginning, once for each density it reaches."""
    found = counted_words(text)
    total, counts = sum(found.values()), Counter()
    for w, n in found.items():
        for f in features_of(w):
            counts[f] += n
    return [f << 2 | i for f, n in counts.items() for i in range(levels(n, total))]


class Marks:
    """The features of words that are known, for texts of which most words have none: words that were met before and have
    none are taken out of a text's words at once, so that only new words and those with features are looked at."""

    def __init__(self, known):
        self.known = known  # features, without their density
        self.marked: dict[bytes, tuple[int, ...]] = {}
        self.plain: set[bytes] = set()

    def __call__(self, text: str | None) -> tuple[dict[int, int], int]:
        """How often each known feature is in a text, and the number of its words."""
        found = LETTERS.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []
        if len(self.plain) + len(self.marked) > 400_000:
            self.plain.clear()
            self.marked.clear()
        marked, known, here = self.marked, self.known, {}
        for w in set(found) - self.plain:
            f = marked.get(w)
            if f is None:
                f = tuple([x for x in features_of(w) if x in known])
                if len(w) <= 64:
                    if f:
                        marked[w] = f
                    else:
                        self.plain.add(w)
            if f:
                here[w] = f
        counts: dict[int, int] = {}
        if here:
            times = Counter(found) if len(here) > 6 else {w: found.count(w) for w in here}
            for w, f in here.items():
                for x in f:
                    counts[x] = counts.get(x, 0) + times[w]
        return counts, len(found)


def margin_of(text: str | None, weights: dict[int, float], bias: float, marks: Marks | dict | None = None) -> float:
    """marks: of the weights' features; made here if there is none yet."""
    counts, total = (marks or marks_of(weights))(text)
    return bias + sum(sorted(weights.get(f << 2 | i, 0.0) for f, n in counts.items() for i in range(levels(n, total)))) if counts else bias


def marks_of(weights: dict[int, float]) -> Marks:
    return Marks({f >> 2 for f in weights})


def probability(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each feature of each text."""
    return np.repeat(np.arange(len(docs)), [len(x) for x in docs]), np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, times: tuple = (None, None)) -> float:
    """The share of toxic texts among the unlabelled, from texts as places of their features, of which there are
    size. It is more than 0 and less than 1, however little the features tell."""
    n_p, n_u = (np.ones(len(d)) if n is None else np.asarray(n, dtype=float) for d, n in zip((positive, unlabelled), times, strict=True))
    (row_p, at_p), (row_u, at_u) = flat(positive), flat(unlabelled)
    of_u = np.bincount(at_u, weights=n_u[row_u], minlength=size) + 0.5
    fold = np.arange(len(positive)) % FOLDS
    scored_p, scored_u = np.zeros(len(positive)), []
    for k in range(min(FOLDS, len(positive))):
        others = fold != k if len(positive) > 1 else fold == k
        of_p = np.bincount(at_p[others[row_p]], weights=n_p[row_p][others[row_p]], minlength=size) + 0.5
        w = np.log(of_p / (n_p[others].sum() + 1)) - np.log(of_u / (n_u.sum() + 1))
        scored_p[fold == k] = np.bincount(row_p, weights=w[at_p], minlength=len(positive))[fold == k]
        scored_u.append(np.bincount(row_u, weights=w[at_u], minlength=len(unlabelled)))
    best = 1.0
    for cut in np.quantile(scored_p, np.linspace(0.02, 1 - PRIOR_SHARE, 25)):
        p = n_p[scored_p >= cut].sum() / n_p.sum()
        u = float(np.mean([n_u[x >= cut].sum() for x in scored_u])) / n_u.sum()
        low = p - PRIOR_Z * np.sqrt(p * (1 - p) / n_p.sum())
        if low > 0:
            best = min(best, (u + PRIOR_Z * np.sqrt(u * (1 - u) / n_u.sum())) / low)
    return float(min(max(best, 1 / (n_u.sum() + 1)), 0.95))


def deviations(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """How many deviations more common features are in positives than in unlabelled texts."""
    both = (in_p + in_u + 1) / (n_p + n_u + 2)
    return ((in_p + 0.5) / (n_p + 1) - (in_u + 0.5) / (n_u + 1)) / np.sqrt(both * (1 - np.minimum(both, 0.999)) * (1 / n_p + 1 / n_u))


def possible(in_p: np.ndarray, in_some: np.ndarray, n_p: int, n_some: int, n_u: int, most: int | None) -> np.ndarray:
    """Which features can still be chosen by counts in all n_u texts, after a sample of n_some of them: all but those
    that are too common, or less telling than ``most`` others, by six deviations of what the sample says."""
    share = (in_some + 0.5) / (n_some + 1)
    off = 6 * np.sqrt(share * (1 - share) / n_some)
    low, high = np.maximum(share - off, 0) * n_u, np.minimum(share + off, 1) * n_u
    p = (in_p + 0.5) / (n_p + 1)
    best, worst = deviations(in_p, low, n_p, n_u), deviations(in_p, high, n_p, n_u)
    sure = np.sort(worst[(p >= 2 * (high + 0.5) / (n_u + 1)) & (worst >= LEAST_Z)])
    least = sure[-most] if most is not None and len(sure) >= most else LEAST_Z
    return (p >= 2 * (low + 0.5) / (n_u + 1)) & (best >= least)


def strongest(features: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, most: int | None = MAX_FEATURES) -> np.ndarray:
    """The selected of the ascending features, given in how many of n_p positives and n_u unlabelled texts each is."""
    often = in_p >= min(LEAST_IN, n_p)
    features, in_p, in_u = features[often], in_p[often], in_u[often]
    p, u = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    z = deviations(in_p, in_u, n_p, n_u)
    # Common in positives and twice as common as elsewhere: the few words that mark the class.
    ok = (z >= LEAST_Z) & (p >= 2 * u)
    return features[ok][np.argsort(-z[ok], kind="stable")[:most]]


def columns_in(doc: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places in chosen of those of a text's features that are chosen."""
    return np.flatnonzero(np.isin(chosen, doc)).astype(np.int32)


def untrained(prior: float) -> tuple[dict[int, float], float]:
    p = min(max(prior, 0.0), 1.0)
    return {}, float(np.log(p / (1 - p))) if 0 < p < 1 else (-50.0 if p == 0 else 50.0)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None = None):
    """({feature: weight}, bias) from lists of the texts' features."""
    if not positive or not unlabelled:
        return untrained(prior or 0.0)
    features, in_p = np.unique(np.concatenate(positive), return_counts=True)
    elsewhere, n = np.unique(np.concatenate(unlabelled), return_counts=True)
    _, i, j = np.intersect1d(features, elsewhere, assume_unique=True, return_indices=True)
    in_u = np.zeros(len(features))
    in_u[i] = n[j]
    chosen = strongest(features, in_p, in_u, len(positive), len(unlabelled))
    return fitted([columns_in(d, chosen) for d in positive], [columns_in(d, chosen) for d in unlabelled], chosen, prior)


def fitted(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float | None, times: tuple = (None, None)):
    """({feature: weight}, bias) from texts as places in chosen; the prior estimated where none is given."""
    if not len(chosen) or not unlabelled or prior == 0:
        return untrained(min(prior or 0.0, 0.49))  # nothing tells toxic texts: none is called so
    return descend(positive, unlabelled, chosen, estimate_prior(positive, unlabelled, len(chosen), times) if prior is None else prior, times=times)


def descend(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-4, times: tuple = (None, None)):
    """({feature: weight}, bias) by full-batch Adam on the non-negative risk; texts as places in chosen. times: how
    many texts each of the positive and the unlabelled stands for, 1 by default."""

    def coo(docs, n):
        return *flat(docs), np.full(len(docs), 1 / len(docs)) if n is None else np.asarray(n, dtype=float) / np.sum(n)

    data_p, data_u = coo(positive, times[0]), coo(unlabelled, times[1])
    w, m, v = (np.zeros(len(chosen) + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -50, 50)))

    def margin(data):
        return np.bincount(data[0], weights=w[:-1][data[1]], minlength=len(data[2])) + w[-1]

    def pull(data, slope):
        slope = slope * data[2]
        return np.append(np.bincount(data[1], weights=slope[data[0]], minlength=len(chosen)), slope.sum())

    for step in range(1, epochs + 1):
        mp, mu = margin(data_p), margin(data_u)
        negative = data_u[2] @ np.logaddexp(0, mu) - prior * (data_p[2] @ np.logaddexp(0, mp))
        grad_negative = pull(data_u, sigmoid(mu)) - prior * pull(data_p, sigmoid(mp))
        g = prior * pull(data_p, sigmoid(mp) - 1) + grad_negative if negative >= 0 else -grad_negative
        g += decay * w * np.append(np.ones(len(chosen)), 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return dict(zip(chosen.tolist(), w[:-1].tolist(), strict=True)), float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, is_train: Column, prior: float | None = None, doc_id: str = "doc_id", text: str = "text",
    max_positive: int | None = MAX_POSITIVE, max_unlabelled: int | None = MAX_UNLABELLED, max_features: int | None = MAX_FEATURES,
):
    """Fit on rows for which is_train (over doc_id) holds; labels: doc_id, toxic. Only labels of toxic documents are used."""
    if prior is not None and not 0 <= prior < 1:
        raise ValueError("a prior is a share from 0 to less than 1")
    by = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("toxic") == 1)).where(is_train).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if max_positive is not None:
        known = known.orderBy(by, "doc_id").limit(max_positive)
    known = materialise(known.withColumn("p", F.lit(1)), "toxic-positives")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull()).where(is_train)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "f": [np.array(text_features(t), dtype=np.int32).tobytes() for t in b["text"]]})

    # Of the texts of an id that repeats, the least, so that reruns agree.
    toxic = texts.join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    positives = materialise(toxic.mapInPandas(listed, "doc_id long, f binary"), "toxic-features")
    n_p = positives.count()
    if not n_p:
        return untrained(prior or 0.0)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, n = np.unique(np.frombuffer(b"".join(b["f"]), dtype=np.int32), return_counts=True)
            yield pd.DataFrame({"feature": at, "n": n})

    counts = positives.mapInPandas(tally, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("in_p")).where(F.col("in_p") >= min(LEAST_IN, n_p)).toArrow().sort_by("feature")
    # Features of the positives, of which max_positive are read: their number is bounded, and so is what goes to each task.
    features, in_p = counts["feature"].to_numpy(), counts["in_p"].to_numpy()

    def count_in(texts: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, int]:
        """How many of the texts hold each candidate, and how many texts there are."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counter, held, n = Counted(candidates), np.zeros(len(candidates), dtype=np.int64), 0
            for b in batches:
                found: list[int] = []
                for t in b["text"]:
                    found += counter(t)
                    if len(found) > COUNTED_AT_ONCE:
                        held += np.bincount(found, minlength=len(candidates))
                        found = []
                held += np.bincount(np.array(found, dtype=np.int64), minlength=len(candidates))
                n += len(b)
            at = np.flatnonzero(held)
            yield pd.DataFrame({"feature": np.append(candidates[at], -1).astype(np.int32), "n": np.append(held[at], n)})

        got = texts.select("text").mapInPandas(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
        of = dict(zip(got["feature"].to_pylist(), got["n"].to_pylist(), strict=True))
        return np.array([of.get(f, 0) for f in candidates.tolist()], dtype=np.float64), of.get(-1, 0)

    some = texts
    if max_unlabelled is not None:
        first = materialise(texts.select("doc_id").orderBy(by, "doc_id").limit(max_unlabelled).distinct(), "toxic-sample")
        some = texts.join(first, "doc_id")
    in_u, n_u = count_in(some, features)
    if max_unlabelled is not None and n_u:
        # What samples rule out isn't counted further; the others are, in all training texts.
        n_all = texts.count()
        open_ = possible(in_p, in_u, n_p, n_u, n_all, max_features)
        features, in_p = features[open_], in_p[open_]
        share = SECOND * max_unlabelled / n_all
        if share < 0.3 and len(features):
            # A larger sample, of what the first one left, where it is still a small part of all.
            seat = F.pmod(F.xxhash64(F.lit("second"), F.col("doc_id")), F.lit(1_000_000))
            in_more, n_more = count_in(texts.where(seat < int(share * 1_000_000)), features)
            if n_more:
                open_ = possible(in_p, in_more, n_p, n_more, n_all, max_features)
                features, in_p = features[open_], in_p[open_]
        in_u, n_u = count_in(texts, features)
    chosen = strongest(features, in_p, in_u, n_p, n_u, max_features) if n_u else features[:0]
    if not len(chosen):
        return fitted([], [], chosen, prior)
    order = np.sort(chosen)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counted(order)
        for b in batches:
            yield pd.DataFrame({"f": [np.array(sorted(counter(t)), dtype=np.int32).tobytes() for t in b["text"]]})

    def patterns(df: DataFrame) -> tuple[list[np.ndarray], list[int]]:
        """Distinct sets of chosen features, with the number of texts that have each."""
        got = df.groupBy("f").agg(F.count("*").alias("n")).toArrow().sort_by("f")
        return [np.frombuffer(f.as_buffer(), dtype=np.int32) for f in got["f"]], got["n"].to_pylist()

    of_p, n_of_p = patterns(toxic.select("text").mapInPandas(place, "f binary"))
    of_u, n_of_u = patterns(some.select("text").mapInPandas(place, "f binary"))
    return fitted(of_p, of_u, order, prior, (n_of_p, n_of_u))


class Counted:
    """Places of a text's features among given ones, in no order."""

    def __init__(self, features: np.ndarray):
        self.places: dict[int, list[int]] = {}
        for i, f in enumerate(features.tolist()):
            self.places.setdefault(f >> 2, [-1] * LEVELS)[f & 3] = i
        self.marks = Marks(self.places)

    def __call__(self, text: str | None) -> list[int]:
        counts, total = self.marks(text)
        return [i for x, n in counts.items() for i in self.places[x][: levels(n, total)] if i >= 0]


def score(docs: DataFrame, model: tuple[dict[int, float], float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    weights, bias = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = marks_of(weights)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [probability(margin_of(t, weights, bias, marks)) for t in b["text"]]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose score stays under the threshold; no shuffle."""
    weights, bias = model

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marks = marks_of(weights)
        for texts in batches:
            yield pd.Series([probability(margin_of(t, weights, bias, marks)) for t in texts])

    scored = F.pandas_udf(run, "double")
    return docs.where(scored(F.col(text)) < threshold)
