"""Whitening of embeddings by cyclic Jacobi rotations.

Entries c become whole numbers x = floor(64 c) + 1 000 000. Three passes over the table, each summed in its tasks
before anything is exchanged: sums S, the scatter, and the covariance of the whitened vectors as a check.

The scatter is that of centred numbers: tasks subtract the whole number next to the mean from each entry before they
multiply, and the driver takes off the rest of the mean. All of it is exact: sums are whole numbers of
any size (they travel in two parts, see ``LIMB``), so n^2 V is known exactly, is rounded once, and is the same in
every rerun, however the rows are dealt out. Matrix products run in doubles where 2^53 holds them, else in
long or unbounded whole numbers.

The driver diagonalises V (width x width, whatever the number of rows) by Jacobi rotations in the round-robin order, in
which a round's rotations touch disjoint pairs and are applied at once; a sweep visits each pair once. It ends
when every off-diagonal entry is negligible beside its own two diagonal entries, not beside the largest, which keeps
small eigenvalues accurate. Eigenvalues are sorted, falling; of a component's two signs, the one whose
largest entry is positive is taken. The whitening matrix goes to all tasks with their code.

Defined cases: vectors that are null or hold null, NaN or infinite entries are dropped; of vectors of several
lengths the commonest is the table's (of equally common ones the longest), others are no vectors of it and are
dropped; x stops at the limits of a long; repeated rows and repeated or null ids are rows like others; components
whose eigenvalue is zero (up to rounding) have null as whitened value, as 0/0 has none; an empty table, or one of
empty vectors, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT, SCALE = 1_000_000, 64.0
COMPONENTS = 32
#: Sums travel as hi * LIMB + lo in two decimals, so that neither overflows, whatever the entries.
LIMB = 1 << 64
LOW, HIGH = -(2**63), 2**63 - 1
SMALL = 2**31  # entries beside the mean that long arithmetic may square and sum
SWEEPS = 60


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the rows that have a vector of finite numbers."""
    v = F.col(embedding).cast("array<double>")
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return table.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", odd))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """x of a batch's vectors, all of which have this width, as longs."""
    c = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    f = np.floor(c * SCALE)
    x = np.empty(f.shape, dtype=np.int64)
    wide = np.abs(f) >= 2.0**62
    x[~wide] = f[~wide].astype(np.int64) + SHIFT
    if wide.any():
        x[wide] = [min(max(int(e) + SHIFT, LOW), HIGH) for e in f[wide]]
    return x


def _beside(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """x minus whole numbers: longs where they hold it, else whole numbers of any size."""
    m = np.array(middle, dtype=object)
    if len(x) and (np.abs(x.astype(np.float64)).max() >= 2.0**61 or max(abs(e) for e in middle) >= 2**61):
        return x.astype(object) - m
    return x - m.astype(np.int64)


def _gram(u: np.ndarray) -> np.ndarray:
    """u'u, exact, as whole numbers of any size."""
    if u.dtype == object:
        return u.T @ u
    most = max(1, int(np.abs(u).max(initial=0)))
    if most * most * len(u) < 2**53:
        f = u.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(u) < 2**63:
        return (u.T @ u).astype(object)
    return u.astype(object).T @ u.astype(object)


def _limbs(values) -> tuple[list[Decimal], list[Decimal]]:
    pairs = [divmod(int(v), LIMB) for v in values]
    return [Decimal(hi) for hi, _ in pairs], [Decimal(lo) for _, lo in pairs]


SUMMED = "i int, j int, hi decimal(38,0), lo decimal(38,0)"


def _summed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums by place: as many rows as the matrix has entries, from all tasks' partial sums."""
    got = rows.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()
    return {(r["i"], r["j"]): int(r["hi"]) * LIMB + int(r["lo"]) for r in got}


def _batch(i, j, values) -> pa.RecordBatch:
    hi, lo = _limbs(values)
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(hi, kind), pa.array(lo, kind)], names=["i", "j", "hi", "lo"])


def sums_of(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of x in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for b in batches:
            x = _matrix(b, width)
            n += len(x)
            plain = len(x) == 0 or np.abs(x.astype(np.float64)).max() * len(x) < 2.0**62
            total += x.sum(axis=0).astype(object) if plain else x.astype(object).sum(axis=0)
        yield _batch(range(width + 1), [0] * (width + 1), [*total, n])

    got = _summed(rows.select("v").mapInArrow(run, SUMMED))
    return got.get((width, 0), 0), [got.get((i, 0), 0) for i in range(width)]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """V of x over all vectors, divisor n, each entry exact but for one rounding."""
    width = len(sums)
    middle = [s // n for s in sums]
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), dtype=object)
        for b in batches:
            total += _gram(_beside(_matrix(b, width), middle))
        yield _batch(i, j, total[i, j])

    got = _summed(rows.select("v").mapInArrow(run, SUMMED))
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]  # n times what is left of the mean
    out = np.zeros((width, width))
    for (a, b), value in got.items():
        out[a, b] = out[b, a] = _ratio(n * value - rest[a] * rest[b], n * n)
    return out


def _ratio(a: int, b: int) -> float:
    """Python rounds a quotient of whole numbers once; beyond a double's range it is infinite."""
    try:
        return a / b
    except OverflowError:
        return float("inf") if a > 0 else float("-inf")


def rounds(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of dimensions in rounds of disjoint pairs (a tournament in which each meets each)."""
    size = width + width % 2
    seats, out = list(range(size)), []
    for _ in range(size - 1):
        pairs = [(a, b) for a, b in zip(seats[: size // 2], reversed(seats[size // 2 :]), strict=True) if max(a, b) < width]
        out.append((np.array([min(p) for p in pairs], dtype=int), np.array([max(p) for p in pairs], dtype=int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(v: np.ndarray, tolerance: float = 2.0**-52) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a, width = v.copy(), len(v)
    e = np.eye(width)
    order = rounds(width) if width > 1 else []
    for _ in range(SWEEPS):
        turned = False
        for p, q in order:
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            needed = np.abs(off) > tolerance * np.sqrt(np.abs(dp) * np.abs(dq))
            if not needed.any():
                continue
            turned = True
            p, q, off, dp, dq = p[needed], q[needed], off[needed], dp[needed], dq[needed]
            theta = (dq - dp) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, e):  # columns of both, then rows of the matrix
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            up, low = a[p, :].copy(), a[q, :].copy()
            a[p, :], a[q, :] = c[:, None] * up - s[:, None] * low, s[:, None] * up + c[:, None] * low
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp - t * off, dq + t * off
        if not turned:
            break
    values = np.diag(a).copy()
    place = np.argsort(-values, kind="stable")
    values, e = values[place], e[:, place]
    e = e / np.linalg.norm(e, axis=0)
    largest = e[np.abs(e).argmax(axis=0), np.arange(width)]
    return values, e * np.where(largest < 0, -1.0, 1.0)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the kept components
    axes: np.ndarray  # width x components, unit columns
    trace: float
    error: float = 0.0  # largest entry of the whitened covariance minus the identity
    full: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))  # components with variance

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def matrix(self) -> np.ndarray:
        return self.axes[:, self.full] / np.sqrt(self.values[self.full])

    def explained(self) -> np.ndarray:
        return self.values * self.full / self.trace if self.trace > 0 else np.zeros(len(self.values))


def _centred(u: np.ndarray, rest: list[int], n: int) -> np.ndarray:
    """x - S/n in doubles from x beside a whole number."""
    return u.astype(np.float64) - np.array([r / n for r in rest])


def width_of(rows: DataFrame) -> int:
    """The commonest length; as many groups as there are lengths, of which one row is taken."""
    got = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return int(got["w"]) if got else 0


def fit(table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> Whitening | None:
    """None where there is nothing to fit: no vector, or only empty ones."""
    rows = vectors(table, vec_id, embedding)
    width = width_of(rows)
    if not width:
        return None
    rows = rows.where(F.size("v") == width)
    n, sums = sums_of(rows, width)
    v = covariance(rows, n, sums)
    values, axes = jacobi(v)
    kept = min(components, width)
    floor = max(float(np.abs(np.diag(v)).max()), 0.0) * width * 2.0**-52
    out = Whitening(n, sums, values[:kept], axes[:, :kept], float(np.trace(v)), full=values[:kept] > floor)
    out.error = identity_error(rows, out)
    return out


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance, as computed for every row, minus the identity."""
    size = int(w.full.sum())
    if not size:
        return 0.0
    middle, matrix, n, width = [s // w.n for s in w.sums], w.matrix, w.n, w.width
    rest = [s - n * m for s, m in zip(w.sums, middle, strict=True)]
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            y = _centred(_beside(_matrix(b, width), middle), rest, n) @ matrix
            total += y.T @ y
            mean += y.sum(axis=0)
        at = pa.array([*i, *range(size)], pa.int32()), pa.array([*j, *[-1] * size], pa.int32())
        yield pa.RecordBatch.from_arrays([*at, pa.array([*total[i, j], *mean], pa.float64())], names=["i", "j", "s"])

    got = {(r["i"], r["j"]): r["s"] / n for r in rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(s - got[a, -1] * got[b, -1] - (a == b)) for (a, b), s in got.items() if b >= 0)


def transform(table: DataFrame, w: Whitening | None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, whitened array<double> (a value for each component), deviation decimal(38,0): the sum over dimensions
    of (n x - S)^2, exact; null where 38 digits don't hold it."""
    rows = vectors(table, vec_id, embedding)
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, whitened array<double>, deviation decimal(38,0)"
    if w is None:
        return table.sparkSession.createDataFrame([], shape)
    n, width, size = w.n, w.width, len(w.values)
    middle, full, matrix = [s // n for s in w.sums], w.full, w.matrix
    rest = [s - n * m for s, m in zip(w.sums, middle, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _beside(_matrix(b, width), middle)
            plain = u.dtype != object and (int(np.abs(u).max(initial=0)) + 1) ** 2 * n * n * width < 2**63
            y = (u if plain else u.astype(object)) * n - np.array(rest, dtype=np.int64 if plain else object)
            deviation = [Decimal(int(d)) if d < 10**38 else None for d in (y * y).sum(axis=1)]
            white = np.full((len(u), size), np.nan)
            white[:, full] = _centred(u, rest, n) @ matrix
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * size, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists, pa.array(deviation, pa.decimal128(38, 0))], names=["vec_id", "whitened", "deviation"])

    return rows.where(F.size("v") == width).mapInArrow(run, shape)


def components(table: DataFrame, w: Whitening | None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation (long; null beyond one), whitened,
    explained, identity_error."""
    explained = F.array(*[F.lit(float(x)) for x in (w.explained() if w else [])]).cast("array<double>")
    rows = transform(table, w, vec_id, embedding).select("vec_id", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(w.error if w else 0.0).alias("identity_error"),
    )
