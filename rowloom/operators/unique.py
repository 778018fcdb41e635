"""Unique values from colliding candidates: the first of equals keeps its value, others get a number.

Whole numbers, decimals, days and moments have bounded domains. What still collides there after one pass gets free
values: taken values are ranked, so that the number of free ones before each is known, and the k-th free value is an
as-of lookup of k among these numbers. That places any number of rows that the domain can hold, in one go."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..errors import UniqueExhausted
from ..scratch import drop, materialise
from .asof import as_of
from .prefix import rank_within

ROUNDS = 6


def suffixed(value: Column, k: Column, kind: str, max_length: int | None = None) -> Column:
    """value with its k-th suffix (k > 0): e-mail before the @, numbers, days and moments by addition, texts
    behind. Texts are cut first, so that the suffix fits."""
    if kind == "number":
        return value + k
    if kind == "date":
        return F.date_add(value, k.cast("int"))
    if kind == "moment":
        return value + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k.cast("decimal(18,6)"))
    tail = F.concat(F.lit("_"), k.cast("string"))
    if kind == "email":
        at = F.instr(value, "@")
        head, rest = F.substr(value, F.lit(1), at - 1), F.substr(value, at, F.length(value))
        if max_length:
            head = F.substr(head, F.lit(1), F.greatest(F.lit(1), F.lit(max_length) - F.length(rest) - F.length(tail)))
        return F.concat(head, tail, rest)
    head = F.substr(value, F.lit(1), F.lit(max_length) - F.length(tail)) if max_length else value
    return F.concat(head, tail)


def one_pass(df: DataFrame, column: str, order: str, kind: str = "text", existing: DataFrame | None = None, max_length: int | None = None, by: tuple[str, ...] = (), behind=None) -> DataFrame:
    """The k-th row of equal values (by order, from 0; from 1 where the value exists already) gets suffix k.
    ``by``: more columns of the key; the suffix goes to ``column``. existing: its columns stand for by and column.
    behind: rows that would get a suffix go behind this greatest value instead, each in its own place."""
    key = (*by, column)
    ranked = rank_within(df, key, order, "__k")
    if existing is not None:
        taken = existing.select(*[F.col(f"`{e}`").cast("string").alias(f"__taken_{i}") for i, e in enumerate(existing.columns[: len(key)])]).distinct()
        on = [F.col(c).cast("string") == F.col(f"__taken_{i}") for i, c in enumerate(key)]
        ranked = ranked.join(taken, on, "left").withColumn("__k", F.col("__k") + F.col("__taken_0").isNotNull().cast("long")).drop(*taken.columns)
    made = suffixed(F.col(column), F.col("__k"), kind, max_length) if behind is None else suffixed(F.lit(behind), F.col(order) + 1, kind)
    # A number that its type doesn't hold is left to the passes that follow.
    made = F.coalesce(made.try_cast(df.schema[column].dataType), F.col(column)) if kind == "number" else made.cast(df.schema[column].dataType)
    new = F.when((F.col("__k") > 0) & F.col(column).isNotNull(), made).otherwise(F.col(column))
    return ranked.withColumn(column, new).drop("__k")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null" for c in columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


#: Whole numbers that a type holds, with room for arithmetic at the ends of the largest.
LIMITS = {T.ByteType: (-(2**7), 2**7 - 1), T.ShortType: (-(2**15), 2**15 - 1), T.IntegerType: (-(2**31), 2**31 - 1), T.LongType: (-(2**61), 2**61), T.DateType: (-719162, 2932896)}


def places_of(kind: T.DataType) -> tuple[tuple[int, int], callable, callable] | None:
    """Limits, and the ways between values of a type and whole numbers in their order; None where it has none."""
    if type(kind) in (T.ByteType, T.ShortType, T.IntegerType, T.LongType):
        return LIMITS[type(kind)], lambda c: c.cast("long"), lambda x: x.cast(kind)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        most = 10**kind.precision - 1
        return (-most, most), lambda c: (c * F.lit(10**kind.scale)).cast("long"), lambda x: (x.cast("decimal(38,0)") / F.lit(10**kind.scale).cast("decimal(20,0)")).cast(kind)
    if isinstance(kind, T.DateType):
        return LIMITS[T.DateType], lambda c: F.unix_date(c).cast("long"), lambda x: F.date_from_unix_date(x.cast("int"))
    return None


def place_free(df: DataFrame, column: str, order: str, by: tuple[str, ...] = (), existing: DataFrame | None = None) -> DataFrame:
    """(order, by, column): the first of equals (by order) keeps its value, unless it exists already; the others get
    values that nobody has, spread over those free between the least and greatest value of the column, or if these don't
    suffice, over its type's. Rows with a null in the key stay as they are. existing: columns by and column, in this order."""
    kind = df.schema[column].dataType
    limits, to_place, to_value = places_of(kind)
    rows = df.select(order, *by, to_place(F.col(column)).alias("__x"), F.col(column))
    whole = " and ".join(f"`{c}` is not null" for c in (*by, "__x"))
    placed = rank_within(rows.where(whole), (*by, "__x"), order, "__k")
    old = None
    if existing is not None:
        given = [F.col(f"`{e}`").cast(df.schema[c].dataType).alias(c) for e, c in zip(existing.columns, (*by, column), strict=False)]
        old = existing.select(*given).select(*by, to_place(F.col(column)).alias("__x")).where(whole).distinct()
        met = old.select(*[F.col(c).alias(f"__e_{c}") for c in (*by, "__x")])
        placed = placed.join(met, [F.col(c) == F.col(f"__e_{c}") for c in (*by, "__x")], "left").withColumn("__k", F.col("__k") + F.col("__e___x").isNotNull().cast("long")).drop(*met.columns)
    placed = materialise(placed, "placed")
    stay, moved = placed.where("__k = 0"), placed.where("__k > 0")
    taken = stay.select(*by, "__x") if old is None else stay.select(*by, "__x").unionByName(old)
    ends = taken.agg(F.min("__x").alias("lo"), F.max("__x").alias("hi")).first()
    # Without by, all rows are one group, of a constant.
    group = list(by) or ["__all"]
    one = lambda f: f if by else f.withColumn("__all", F.lit(0))
    wanted = one(moved).groupBy(*group).agg(F.count("*").alias("__wanted"))
    for lo, hi in dict.fromkeys(((ends["lo"], ends["hi"]), (max(limits[0], min(0, ends["lo"])), limits[1]), limits) if ends["lo"] is not None else ()):
        inside = taken.where(F.col("__x").between(lo, hi))
        held = one(inside).groupBy(*group).agg(F.count("*").alias("__held"))
        room = wanted.join(held, group, "left").select(*group, "__wanted", (F.lit(hi - lo + 1) - F.coalesce("__held", F.lit(0))).alias("__free"))
        if room.where("__free < __wanted").isEmpty():
            break
    else:
        if moved.isEmpty():
            return df.select(order, *by, column)
        raise UniqueExhausted(f"no more unique values for {', '.join((*by, column))}: {kind.simpleString()} has too few", hints=("fewer rows, or a wider type",))
    room = materialise(room, "room")
    # A start: from this number of free values on, this many taken ones lie before. Ranks make both known.
    ranked = rank_within(inside, by, "__x", "__i", max(1 << 16, (hi - lo) >> 16))
    starts = ranked.select(*by, (F.col("__x") - F.lit(lo) - F.col("__i")).alias("__at"), (F.col("__i") + 1).alias("__shift"))
    want = rank_within(moved.select(order, *by), by, order, "__n")
    want = one(want).join(room, group)
    spread = F.floor(F.col("__n").cast("decimal(38,0)") * F.col("__free") / F.col("__wanted")).cast("long")
    want = want.select(order, *by, F.least(spread, F.col("__free") - 1).alias("__at"))
    width = max(1, (hi - lo) >> 10)
    found = as_of(want, starts, "__at", "__shift", "__shift", lambda at: F.floor(at / F.lit(width)), by)
    new = found.select(order, *by, to_value(F.lit(lo) + F.col("__at") + F.coalesce("__shift", F.lit(0))).alias(column))
    rest = df.where(" or ".join(f"`{c}` is null" for c in (*by, column))).select(order, *by, column)
    return stay.select(order, *by, column).unionByName(new).unionByName(rest)


def resolve(df: DataFrame, column: str, order: str, kind: str = "text", existing: DataFrame | None = None, max_length: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Passes until no value repeats: a suffixed value may meet a natural one. Each pass settles what the
    one before left; ends with an error when values run out. What collides after the first pass in a
    bounded domain gets free values (``place_free``).

    Passes run over the key and the order alone, are written once each, and are checked by one job; the
    other columns of df join the result once, by the order (distinct)."""
    key = [*by, column]
    out, behind = df.select(order, *key), None
    for again in range(ROUNDS):
        last = out
        if again and places_of(df.schema[column].dataType) is not None:
            out = materialise(place_free(out, column, order, by, existing), "unique")
        else:
            if again and kind in ("number", "date", "moment"):
                # Neighbours are taken too: what still meets goes behind all values.
                tops = [f.agg(F.max(F.col(f.columns[-1]))) for f in (out, existing.select(existing.columns[len(by)]).select(F.col(existing.columns[len(by)]).cast(df.schema[column].dataType)) if existing is not None else out.select(column))]
                behind = max(r[0] for f in tops for r in f.collect() if r[0] is not None)  # a row each
            out = materialise(one_pass(out, column, order, kind, existing, max_length, by, behind), "unique")
        drop(last)
        wrong = [duplicates(out, key).select(F.lit("again").alias("why")).limit(1)]
        if existing is not None:
            met = [F.col(c).cast("string") == F.col(f"__e{i}") for i, c in enumerate(key)]
            wrong.append(out.join(existing.select(*[F.col(f"`{e}`").cast("string").alias(f"__e{i}") for i, e in enumerate(existing.columns[: len(key)])]), met, "left_semi").select(F.lit("again").alias("why")).limit(1))
        if max_length and kind in ("text", "email"):
            wrong.append(out.where(F.length(column) > max_length).select(F.lit("long").alias("why")).limit(1))
        found = {r["why"] for r in reduce(DataFrame.unionAll, wrong).collect()}  # three rows at most
        if "long" in found:
            break  # suffixes no longer fit
        if not found:
            if set(df.columns) == {order, *key}:
                return out.select(*df.columns)
            rest = df.drop(column)
            return rest.join(out.select(F.col(order).alias("__at"), column), F.col(order) == F.col("__at")).drop("__at").select(*df.columns)
    raise UniqueExhausted(f"no more unique values for {', '.join(key)}")


def by_row(value: Column, row: Column, kind: str, max_length: int | None = None) -> Column:
    """Unique without looking at other rows, as a stream needs it: the row number is part of every value
    (behind the last underscore of texts; a number is the row's own)."""
    if kind in ("number", "date", "moment"):
        return {"number": row + 1, "date": F.date_add(F.lit("1970-01-01").cast("date"), row.cast("int")), "moment": F.timestamp_seconds(row)}[kind]
    return suffixed(value, row, kind, max_length)


def tuple_ordinals(row: Column, sizes: list[int], seed: int) -> list[Column]:
    """Distinct tuples for rows 0..n-1, n at most the product of sizes: row numbers are permuted by an
    affine map modulo the product (its factor is prime to it), and split into digits of these sizes."""
    total = math.prod(sizes)
    return digits_of(permuted(row, total, seed), sizes)


def permuted(row: Column, total: int, seed: int) -> Column:
    """0..total-1 in another order: an affine map whose factor is prime to total."""
    # Near to the golden section, so that neighbours land far apart in domains of any size.
    start = (total * 618033988 // 10**9 + (seed * 2 + 1) * 48271) % total | 1
    factor = next(f for f in range(start, 2 * total + 3) if math.gcd(f, total) == 1) % total if total > 1 else 1
    return F.pmod(row.cast("decimal(38,0)") * F.lit(factor).cast("decimal(20,0)") + F.lit(seed % total), F.lit(total).cast("decimal(20,0)")).cast("long")


def digits_of(place: Column, sizes: list[int]) -> list[Column]:
    """A number's digits in these bases, the last one lowest; the first is what is left, modulo its size."""
    out: list[Column] = []
    for size in reversed(sizes[1:]):
        out.append(F.pmod(place, F.lit(size)))
        place = F.call_function("div", place, F.lit(size))
    return [F.pmod(place, F.lit(sizes[0])), *reversed(out)] if sizes else []


def dealt_ordinals(row: Column, sizes: list[int], seed: int) -> list[Column]:
    """Distinct tuples for rows 0..n-1 like tuple_ordinals, in which the values of the last columns come equally
    often (to one): row numbers' digits, each permuted for itself."""
    return [permuted(d, size, seed + i) for i, (d, size) in enumerate(zip(digits_of(row, sizes), sizes, strict=True))]


def pair_ordinals(row: Column, left: int, right: int, seed: int) -> tuple[Column, Column]:
    """tuple_ordinals of two."""
    a, b = tuple_ordinals(row, [left, right], seed)
    return a, b
