"""CHECK constraints that bound columns: intervals of a column, and order between two columns.

A conjunction of comparisons is read into domains: ``price >= 0 AND price < 100``, ``rating BETWEEN 1 AND 5``, ``0 < x``,
``starts < ends``, with casts, brackets and quoted names around them. What has other parts (OR, functions, arithmetic
between columns) is left alone as a whole. Values that a column's builder makes are kept where they lie in its
domain; others are drawn from it. Columns that must not be before others are drawn above them, along the order."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.values import Ctx
from ..schema import Column, Kind, Table

WHOLE = (Kind.SMALLINT, Kind.INTEGER, Kind.BIGINT)
NUMBERS = (*WHOLE, Kind.REAL, Kind.DOUBLE, Kind.DECIMAL)
TIMES = (Kind.DATE, Kind.TIMESTAMP, Kind.TIMESTAMPTZ)
#: How far values go where only one end is known: numbers, and days of times.
REACH, REACH_DAYS = 1000, 365
LIMITS = {Kind.SMALLINT: (-(2**15), 2**15 - 1), Kind.INTEGER: (-(2**31), 2**31 - 1), Kind.BIGINT: (-(2**62), 2**62)}

NAME = r'(?:"[^"]+"|`[^`]+`|[A-Za-z_][\w$]*)'
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
COMPARED = re.compile(rf"({NAME}|{NUMBER})\s*(<=|>=|<|>)\s*({NAME}|{NUMBER})")
WITHIN = re.compile(rf"({NAME})\s+BETWEEN\s+({NUMBER})\s+AND\s+({NUMBER})", re.I)
PRESENT = re.compile(rf"{NAME}\s+IS\s+NOT\s+NULL", re.I)
TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Interval:
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False

    def meet(self, op: str, x: float) -> Interval:
        if op in (">", ">="):
            closer = self.low is None or x > self.low or (x == self.low and op == ">")
            return replace(self, low=x, low_open=op == ">") if closer else self
        closer = self.high is None or x < self.high or (x == self.high and op == "<")
        return replace(self, high=x, high_open=op == "<") if closer else self


@dataclass
class Domains:
    intervals: dict[str, Interval] = field(default_factory=dict)
    #: (first, then, strict): then is never less than first, or is more.
    orders: list[tuple[str, str, bool]] = field(default_factory=list)


def _bare(expression: str) -> str:
    """Without CHECK, casts, and brackets, which only group in what is read here."""
    text = re.sub(r"^\s*CHECK\b", "", expression, flags=re.I)
    text = re.sub(r"::\s*(?:character varying|double precision|timestamp with(?:out)? time zone|\w+)(?:\s*\([\d,\s]*\))?", "", text, flags=re.I)
    text = re.sub(r"'(" + NUMBER + r")'", r"\1", text)
    # A name before a bracket is a function: it stays, so that nothing matches.
    return text if re.search(rf"(?!\b(?:AND|BETWEEN)\b){NAME}\s*\(", re.sub(r"\b(?:AND|BETWEEN)\b\s*\(", "(", text, flags=re.I)) else re.sub(r"[()]", " ", text)


def read(expression: str) -> Domains | None:
    """What a constraint says, or None where it says something else too."""
    out, text = Domains(), _bare(expression)
    name = lambda x: x.strip('"`')
    held: list[str] = []
    text = WITHIN.sub(lambda m: held.append(f"{m[1]} >= {m[2]}") or held.append(f"{m[1]} <= {m[3]}") or "TRUE", text)
    for part in [*re.split(r"\bAND\b", text, flags=re.I), *held]:
        part = part.strip()
        if part == "TRUE" or PRESENT.fullmatch(part):
            continue
        m = COMPARED.fullmatch(part)
        if not m:
            return None
        a, op, b = m.groups()
        numbers = [bool(re.fullmatch(NUMBER, x)) for x in (a, b)]
        if all(numbers):
            return None
        if numbers[0]:
            a, op, b, numbers = b, TURNED[op], a, [False, True]
        if numbers[1]:
            out.intervals[name(a)] = out.intervals.get(name(a), Interval()).meet(op, float(b))
        else:
            first, then = (a, b) if op in ("<", "<=") else (b, a)
            out.orders.append((name(first), name(then), op in ("<", ">")))
    return out


def domains(table: Table) -> Domains:
    """All that a table's constraints say of columns that hold numbers, or in orders also times."""
    out, kinds = Domains(), {c.name: c.kind for c in table.columns}
    for check in table.checks:
        said = read(check.expression)
        if said is None:
            continue
        for c, i in said.intervals.items():
            if kinds.get(c) in NUMBERS:
                own = out.intervals.get(c, Interval())
                for op, x in ((">" if i.low_open else ">=", i.low), ("<" if i.high_open else "<=", i.high)):
                    own = own.meet(op, x) if x is not None else own
                out.intervals[c] = own
        for a, b, strict in said.orders:
            if (kinds.get(a) in NUMBERS and kinds.get(b) in NUMBERS) or (kinds.get(a) in TIMES and kinds.get(a) == kinds.get(b)):
                out.orders.append((a, b, strict))
    return out


def step(c: Column) -> float:
    """The least difference of two values of a column."""
    if c.kind is Kind.DECIMAL:
        return 10.0 ** -(2 if c.scale is None else c.scale)
    return 1.0 if c.kind in WHOLE else 1e-4


def units(c: Column, i: Interval) -> tuple[int | None, int | None]:
    """An interval in whole steps of the column, both ends within it."""
    size = step(c)
    exact = lambda x: round(x / size, 6)
    low = None if i.low is None else math.ceil(exact(i.low)) + (i.low_open and math.ceil(exact(i.low)) == exact(i.low))
    high = None if i.high is None else math.floor(exact(i.high)) - (i.high_open and math.floor(exact(i.high)) == exact(i.high))
    least, most = LIMITS.get(c.kind, (None, None))
    if c.kind is Kind.DECIMAL:
        most = 10 ** (c.precision or 10) - 1
        least = -most
    low = low if least is None else max(least, low) if low is not None else None
    high = high if most is None else min(most, high) if high is not None else None
    return low, high


def to_units(v: SparkColumn, c: Column) -> SparkColumn:
    return v.cast("long") if c.kind in WHOLE else F.round(v.cast("double") / F.lit(step(c))).cast("long")


def from_units(x: SparkColumn, c: Column) -> SparkColumn:
    if c.kind in WHOLE:
        return x.cast(c.spark_type())
    if c.kind is Kind.DECIMAL:
        return (x.cast("decimal(38,0)") / F.lit(10 ** (2 if c.scale is None else c.scale)).cast("decimal(20,0)")).cast(c.spark_type())
    return (x * F.lit(step(c))).cast(c.spark_type())


def drawn(ctx: Ctx, c: Column, low, high) -> SparkColumn:
    """A whole number of steps from low to high (columns or numbers)."""
    low, high = (x if isinstance(x, SparkColumn) else F.lit(x) for x in (low, high))
    return low + F.floor(ctx.u(0, f"{c.name}~") * (high - low + 1)).cast("long")


def bounded(v: SparkColumn, c: Column, i: Interval, ctx: Ctx) -> SparkColumn:
    """v where it lies in the interval, else a draw from it."""
    from ..errors import GenerationFailed

    low, high = units(c, i)
    reach = max(1, int(REACH / step(c)))
    low, high = (high - reach if low is None else low), (low + reach if high is None else high)
    if low > high:
        raise GenerationFailed(f"{ctx.table}.{c.name}: nothing lies between {i.low} and {i.high}")
    inside = F.lit(True)
    if i.low is not None:
        inside = inside & (v > F.lit(i.low) if i.low_open else v >= F.lit(i.low))
    if i.high is not None:
        inside = inside & (v < F.lit(i.high) if i.high_open else v <= F.lit(i.high))
    return F.when(v.isNull() | inside, v).otherwise(from_units(drawn(ctx, c, low, high), c))


def ranked(orders: list[tuple[str, str, bool]]) -> list[str] | None:
    """Columns so that each comes behind those it mustn't be before; None where they form a circle."""
    names = list(dict.fromkeys(x for a, b, _ in orders for x in (a, b)))
    out: list[str] = []
    while len(out) < len(names):
        free = [x for x in names if x not in out and all(a in out for a, b, _ in orders if b == x)]
        if not free:
            return None
        out += free
    return out


def room_above(table: Table, d: Domains) -> dict[str, float]:
    """The greatest value each column may take so that those that must be above it still fit their own intervals."""
    most = {c: i.high for c, i in d.intervals.items() if i.high is not None}
    for x in reversed(ranked(d.orders) or []):
        for a, b, strict in d.orders:
            if a == x and b in most:
                high = most[b] - (step(table.column(b)) if strict else 0)
                most[x] = min(most.get(x, high), high)
    return most


def apply(values: dict[str, SparkColumn], table: Table, context, fixed: set[str] = frozenset()) -> dict[str, SparkColumn]:
    """values with those of constrained columns moved into their domains. context: Ctx by column name; fixed: columns
    whose values stay (references, lists). Columns in a circle of orders keep their values."""
    d = domains(table)
    if not d.intervals and not d.orders:
        return values
    out, order = dict(values), ranked(d.orders)
    if order is None:
        d, order = Domains(d.intervals), []
    above = room_above(table, d)
    for name in [*(c for c in d.intervals if c not in order), *order]:
        if name not in out or name in fixed:
            continue
        c, ctx = table.column(name), context(name)
        i = d.intervals.get(name, Interval())
        if name in above and (i.high is None or above[name] < i.high):
            i = replace(i, high=above[name], high_open=False)
        if c.kind in NUMBERS and (i.low is not None or i.high is not None):
            out[name] = bounded(out[name], c, i, ctx)
        for a, b, strict in d.orders:
            if b != name or a not in out:
                continue
            first, v = out[a], out[name]
            if c.kind in NUMBERS:
                # Whole steps above the first one, also where its own steps are finer.
                own = F.floor(first.cast("double") / F.lit(step(c)) + F.lit(1e-9)).cast("long") + 1 if strict else F.ceil(first.cast("double") / F.lit(step(c)) - F.lit(1e-9)).cast("long")
                _, high = units(c, i)
                top = own + F.lit(max(1, int(REACH / step(c))))
                top = top if high is None else F.greatest(own, F.lit(high))
                moved = from_units(drawn(ctx, c, own, top), c)
            elif c.kind is Kind.DATE:
                moved = F.date_add(first, (rng.between(ctx.u(0, f"{name}~"), int(strict), REACH_DAYS)).cast("int"))
            else:
                moved = first + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), rng.between(ctx.u(0, f"{name}~"), int(strict), REACH_DAYS * 86400).cast("decimal(18,6)"))
            holds = v > first if strict else v >= first
            out[name] = F.when(v.isNull() | first.isNull() | holds, v).otherwise(moved.cast(c.spark_type()))
    return out
