"""Column groups that belong together: name and gender, place, and points in time.

Points in time are ordered by what they are the time of: events form a graph (created before paid before shipped), and
the columns of a table that it connects get values along it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import corpora, rng
from ..functions.values import DAY, FIRST_F, FIRST_M, LAST, PLACES, Ctx, postal_of
from ..schema import Kind, Table
from . import vocabulary

#: Events by the ones that come before them, directly.
EARLIER: dict[str, set[str]] = {}
for _first, _then in vocabulary.EARLIER_LATER:
    EARLIER.setdefault(vocabulary.squeezed(_then), set()).add(vocabulary.squeezed(_first))
TIMES = (Kind.DATE, Kind.TIMESTAMP, Kind.TIMESTAMPTZ)


@dataclass(frozen=True)
class Group:
    kind: str  # person, place, time (a pair), times (more of them)
    columns: tuple[tuple[str, str], ...]  # role, column; of times: levels as first-end (with a d for dates), column


def find(table: Table, *choices: str) -> str | None:
    by = {c.name.lower(): c.name for c in table.columns}
    return next((by[x] for x in choices if x in by), None)


def detect(table: Table) -> list[Group]:
    out = []
    person = [(r, c) for r, c in (("first", find(table, "first_name", "firstname", "given_name")), ("last", find(table, "last_name", "surname")), ("gender", find(table, "gender", "sex"))) if c]
    if {"first", "gender"} <= {r for r, _ in person}:
        out.append(Group("person", tuple(person)))
    place = [(r, c) for r, c in (("city", find(table, "city", "town")), ("state", find(table, "state", "province")), ("zip", find(table, "zip_code", "zip", "postal_code"))) if c]
    if len(place) > 1:
        out.append(Group("place", tuple(place)))
    return out + time_groups(table)


def earlier_events(event: str) -> set[str]:
    """All events that come before one, directly or not."""
    out, open_ = set(), [event]
    while open_:
        for e in EARLIER.get(open_.pop(), ()):
            if e not in out:
                out.add(e)
                open_.append(e)
    return out


def time_groups(table: Table) -> list[Group]:
    """Time columns that are ordered among each other, by connected parts of the order. A column's level is the length
    of the longest chain of columns before it, so columns of one level aren't ordered."""
    event = {c.name: vocabulary.event_of(c.name) for c in table.columns if c.kind in TIMES}
    before = {c: {x for x in event if event[x] in earlier_events(event[c])} for c in event}
    level: dict[str, int] = {}

    def level_of(c: str) -> int:
        if c not in level:
            level[c] = max((level_of(x) + 1 for x in before[c]), default=0)
        return level[c]

    out, left = [], [c for c in event if before[c] or any(c in b for b in before.values())]
    while left:
        part, open_ = {left[0]}, [left[0]]
        while open_:
            c = open_.pop()
            near = {x for x in left if (x in before[c] or c in before[x]) and x not in part}
            part |= near
            open_ += near
        ordered = sorted(part, key=lambda c: (level_of(c), c))
        if len(ordered) == 2:
            out.append(Group("time", (("before", ordered[0]), ("after", ordered[1]))))
        else:
            end = {c: min([level_of(x) for x in part if c in before[x]], default=level_of(ordered[-1]) + 1) for c in part}
            out.append(Group("times", tuple((f"{level_of(c)}-{end[c]}{'d' if table.column(c).kind is Kind.DATE else ''}", c) for c in ordered)))
        left = [c for c in left if c not in part]
    return out


def times_in_order(group: Group, ctx: Ctx, span: int = 2 * 365 * DAY) -> dict[str, Column]:
    """Moments of a group's columns: levels begin where order statistics of as many uniform draws as there are
    levels say, and a column lies between its level's begin and that of the first column that must follow. Levels are a
    second apart at least, or a day where there are dates, so a column is before all that follow it."""
    unit = DAY if any(r.endswith("d") for r, _ in group.columns) else 1
    level = {c: tuple(map(int, r.rstrip("d").split("-"))) for r, c in group.columns}
    levels_ = max(first for first, _ in level.values()) + 1
    steps = span // unit - levels_
    drawn = F.array_sort(F.array(*[F.floor(ctx.u(i, "__times") * F.lit(steps)).cast("long") for i in range(levels_)]))
    out = {}
    for role, c in group.columns:
        k, end = level[c]
        low = F.get(drawn, F.lit(k))
        high = F.get(drawn, F.lit(end)) if end < levels_ else F.lit(steps).cast("long")
        at = low + F.floor(ctx.u(0, c) * (high - low)).cast("long") + F.lit(k)  # below the next level's by one unit at least
        inside = F.lit(0) if role.endswith("d") else F.floor(ctx.u(1, c) * F.lit(unit)).cast("long")
        out[c] = F.timestamp_seconds(F.lit((ctx.ref - span) // unit * unit) + at * F.lit(unit) + inside)
    return out


def time_pair(seed: int, table: str, first: str, second: str, row: Column, ref: int, span: int = 2 * 365 * DAY) -> tuple[Column, Column]:
    """Epoch seconds: first in [ref - span, ref], second in [first, ref]. Pairs that share their first column
    share its value, as it is drawn by name."""
    a = F.lit(ref) - F.floor(rng.uniform(seed, table, first, row, 0) * F.lit(span)).cast("long")
    b = a + F.floor(rng.uniform(seed, table, second, row, 1) * (F.lit(ref) - a)).cast("long")
    return a, b


def columns_of(group: Group, ctx: Ctx) -> dict[str, Column]:
    by = dict(group.columns)
    if group.kind == "person":
        female = ctx.u(0, "__sex") < 0.5
        out = {by["first"]: F.when(female, rng.pick(ctx.u(1, "__sex"), ctx.corpus("first_f") or FIRST_F)).otherwise(rng.pick(ctx.u(1, "__sex"), ctx.corpus("first_m") or FIRST_M)), by["gender"]: F.when(female, "female").otherwise("male")}
        if "last" in by:
            last = ctx.corpus("last")
            out[by["last"]] = rng.pick(ctx.u(2, "__sex"), LAST) if last is None else corpora.drawn(ctx.u(2, "__sex"), last)
        return out
    if group.kind == "place":
        found = ctx.corpus("place")
        if found is not None:
            place = {k: corpora.drawn(ctx.u(0, "__place"), [p[i] for p in found]) for i, k in enumerate(("city", "state", "zip"))}
            place["zip"] = postal_of(place["zip"], found[0][3], ctx.u(1, "__place"))
            return {c: place[r] for r, c in group.columns}
        place = {k: rng.pick(ctx.u(0, "__place"), [p[i] for p in PLACES]) for i, k in enumerate(("city", "state", "zip"))}
        place["zip"] = F.concat(place["zip"], F.lpad(rng.between(ctx.u(1, "__place"), 0, 99).cast("string"), 2, "0"))
        return {c: place[r] for r, c in group.columns}
    if group.kind == "times":
        return times_in_order(group, ctx)
    a, b = time_pair(ctx.seed, ctx.table, by["before"], by["after"], ctx.row, ctx.ref)
    return {by["before"]: F.timestamp_seconds(a), by["after"]: F.timestamp_seconds(b)}
