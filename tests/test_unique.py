"""Unique values in bounded domains, and unique keys that share columns."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowloom.errors import GenerationFailed, UniqueExhausted
from rowloom.operators import generate, unique
from rowloom.operators.asof import as_of
from rowloom.schema import Column, ForeignKey, Kind, Schema, Table

KEY = Column("id", Kind.INTEGER, nullable=False, auto_increment=True)


def test_as_of_equals_a_search(spark):
    import bisect
    import random

    rnd = random.Random(1)
    starts = {b: sorted(rnd.sample(range(1000), 40)) for b in "xy"}
    points = [(rnd.choice("xyz"), rnd.randrange(-5, 1100), i) for i in range(500)]
    a = spark.createDataFrame(points, "g string, at long, i long")
    b = spark.createDataFrame([(g, x, k + 1) for g, xs in starts.items() for k, x in enumerate(xs)], "g string, at long, v long")
    got = as_of(a, b, "at", "v", "found", lambda at: F.floor(at / 64), ("g",)).collect()
    assert len(got) == 500
    for r in got:
        assert r["found"] == (bisect.bisect_right(starts.get(r["g"], []), r["at"]) or None)


def placed(spark, values, shape, by=(), existing=None):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "n long, " + shape)
    old = spark.createDataFrame(existing, shape) if existing is not None else None
    return {r["n"]: tuple(r[1:]) for r in unique.place_free(df, df.columns[-1], "n", by, old).collect()}


def test_free_values_fill_what_is_left(spark):
    got = placed(spark, [(5,)] * 6 + [(1,), (10,), (None,)], "v smallint")
    assert got[0] == (5,) and got[6] == (1,) and got[7] == (10,) and got[8] == (None,)
    values = [got[i][0] for i in range(8)]
    assert len(set(values)) == 8 and all(1 <= v <= 10 for v in values)
    # Every value between the ends is taken: the type's others follow.
    got = placed(spark, [(v,) for v in (1, 2, 3)] * 2, "v tinyint")
    assert len(set(got.values())) == 6
    # A full domain, to the last value.
    full = placed(spark, [(7,)] * 256, "v tinyint")
    assert {v for (v,) in full.values()} == set(range(-128, 128))
    with pytest.raises(UniqueExhausted):
        placed(spark, [(7,)] * 257, "v tinyint")


def test_free_values_of_other_kinds_and_beside_existing_ones(spark):
    old = [("a", 1), ("a", 3), ("b", 2), ("b", None)]
    got = placed(spark, [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), (None, 2), (None, 2)], "g string, v int", ("g",), old)
    rows = [v for v in got.values() if v[0] is not None]
    assert len(set(rows) | {o for o in old if o[1]}) == len(rows) + 3
    assert got[3] == ("b", 1) and got[5] == got[6] == (None, 2)
    days = placed(spark, [(dt.date(2020, 1, 1),)] * 3 + [(dt.date(2020, 1, 9),)], "v date")
    assert len(set(days.values())) == 4 and all(dt.date(2020, 1, 1) <= d <= dt.date(2020, 1, 9) for (d,) in days.values())
    money = placed(spark, [(Decimal("0.01"),)] * 9 + [(Decimal("0.09"),)], "v decimal(4,2)")
    assert len(set(money.values())) == 10


def test_unique_small_numbers_within_parents(spark):
    """The case that overflowed: 5000 rows of unique (p_id, SMALLINT) over 3 parents."""
    s = Schema.of(
        Table("p", (KEY,), ("id",)),
        Table("c", (KEY, Column("p_id", Kind.INTEGER, nullable=False), Column("slot", Kind.SMALLINT, nullable=False)), ("id",), (ForeignKey(("p_id",), "p", ("id",)),), uniques=(("p_id", "slot"),)),
    )
    got = generate.generate(spark, s, generate.Config(rows_of={"p": 3, "c": 5000})).tables["c"]
    assert got.select("p_id", "slot").distinct().count() == 5000 and got.where("slot is null").isEmpty()
    many = Schema.of(Table("c", (KEY, Column("slot", Kind.SMALLINT, nullable=False)), ("id",), uniques=(("slot",),)))
    got = generate.generate(spark, many, generate.Config(rows=40_000)).tables["c"]
    assert got.select("slot").distinct().count() == 40_000
    with pytest.raises(UniqueExhausted):
        generate.generate(spark, many, generate.Config(rows=70_000)).tables["c"].count()


def enum(name, n):
    return Column(name, Kind.ENUM, nullable=False, values=tuple(f"{name}{i}" for i in range(n)))


def keys_of(spark, n, columns, *keys, existing=None):
    s = Schema.of(Table("t", (KEY, *columns), ("id",), uniques=keys))
    got = generate.generate(spark, s, generate.Config(rows=n), {"t": existing} if existing is not None else None).tables["t"]
    rows = got.collect()
    assert len(rows) == n and all(r[c.name] is not None for r in rows for c in columns)
    for k in keys:
        assert len({tuple(r[c] for c in k) for r in rows}) == n, k
    return rows


def test_keys_that_share_columns(spark):
    """(a, b) and (b, c) over 4, 26 and 4 values: 104 rows are all there can be."""
    columns = enum("a", 4), enum("b", 26), enum("c", 4)
    for n in (80, 104):
        rows = keys_of(spark, n, columns, ("a", "b"), ("b", "c"))
        assert set(Counter(r["b"] for r in rows).values()) <= {n // 26, n // 26 + 1}
    with pytest.raises(GenerationFailed, match="distinct"):
        keys_of(spark, 105, columns, ("a", "b"), ("b", "c"))
    # A chain of three keys, and one that lies on both ends of it.
    keys_of(spark, 60, (enum("a", 9), enum("b", 12), enum("c", 11), enum("d", 9)), ("a", "b"), ("b", "c"), ("c", "d"))
    with pytest.raises(GenerationFailed):
        keys_of(spark, 30, (enum("a", 2), enum("b", 40), enum("c", 2)), ("a", "b"), ("b", "c"), ("a", "c"))


def test_keys_that_share_references_and_go_around_existing_rows(spark):
    ref = lambda name, to: ForeignKey((f"{name}_id",), to, ("id",))
    column = lambda name: Column(f"{name}_id", Kind.INTEGER, nullable=False)
    s = Schema.of(
        Table("p", (KEY,), ("id",)), Table("q", (KEY,), ("id",)), Table("r", (KEY,), ("id",)),
        Table("t", (column("p"), column("q"), column("r")), ("p_id", "q_id"), (ref("p", "p"), ref("q", "q"), ref("r", "r")), uniques=(("q_id", "r_id"),)),
    )
    old = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 3)], "p_id int, q_id int, r_id int")
    got = generate.generate(spark, s, generate.Config(rows_of={"p": 9, "q": 8, "r": 9, "t": 50}), {"t": old}).tables["t"]
    every = got.unionByName(old)
    assert got.count() == 50 and every.select("p_id", "q_id").distinct().count() == 53 == every.select("q_id", "r_id").distinct().count()
