"""CHECK domains, orders of times, exact Zipf draws, and what column names say."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.errors import GenerationFailed
from rowloom.functions import rng
from rowloom.operators import coherence, generate, mapping, predicates, vocabulary
from rowloom.operators.predicates import Interval, read
from rowloom.schema import Check, Column, Kind, Schema, Table

KEY = Column("id", Kind.INTEGER, nullable=False, auto_increment=True)


def number(name, kind=Kind.INTEGER, **more):
    return Column(name, kind, nullable=False, **more)


def made(spark, table, n=500, **config):
    return generate.generate(spark, Schema.of(table), generate.Config(rows=n, **config)).tables[table.name]


@pytest.mark.parametrize(
    ("expression", "column", "interval"),
    [
        ("price >= 0 AND price < 100", "price", Interval(0, 100, False, True)),
        ("CHECK (((price >= (0)::numeric) AND (price <= (9.5)::numeric)))", "price", Interval(0, 9.5)),
        ("rating BETWEEN 1 AND 5", "rating", Interval(1, 5)),
        ('(("my col" > 3))', "my col", Interval(3, None, True)),
        ("0 < x", "x", Interval(0, None, True)),
        ("x IS NOT NULL AND x >= -1.5", "x", Interval(-1.5)),
        ("x > 1 AND x >= 1 AND x < 9 AND x < 7", "x", Interval(1, 7, True, True)),
        ("quantity >= '0'::integer", "quantity", Interval(0)),
    ],
)
def test_intervals(expression, column, interval):
    assert read(expression).intervals == {column: interval}


@pytest.mark.parametrize("expression", ["price > 0 OR price < -5", "length(name) > 3", "a + b < 5", "state IN ('a', 'b')", "x <> 3", "1 < 2", "NOT x > 3", "abs(x) < 4 AND x > 1", ""])
def test_other_constraints_are_left_alone(expression):
    assert read(expression) is None


def test_orders_are_read():
    assert read("starts < ends AND a >= b").orders == [("starts", "ends", True), ("b", "a", False)]


def test_values_lie_in_their_domains(spark):
    t = Table(
        "t",
        (KEY, number("price", Kind.DECIMAL, precision=8, scale=2), number("rating", Kind.SMALLINT), number("share", Kind.DOUBLE), number("debt"), number("low"), number("mid", Kind.DECIMAL, precision=9, scale=1), number("high")),
        ("id",),
        checks=tuple(Check(x) for x in ("price >= 0 AND price < 3", "rating BETWEEN 1 AND 5", "share > 0 AND share < 0.01", "debt < 0", "low < mid AND mid <= high", "high <= 40", "low >= 10")),
    )
    df = made(spark, t, 2000)
    wrong = df.where("price < 0 or price >= 3 or rating not between 1 and 5 or share <= 0 or share >= 0.01 or debt >= 0 or low >= mid or mid > high or high > 40 or low < 10")
    assert wrong.count() == 0 and df.count() == 2000 and df.select("price").distinct().count() > 100 and df.select("mid").distinct().count() > 100


def test_orders_of_times_and_circles(spark):
    t = Table("t", (KEY, Column("opens", Kind.TIMESTAMP), Column("shuts", Kind.TIMESTAMP), Column("first", Kind.DATE), Column("last", Kind.DATE)), ("id",), checks=(Check("opens < shuts"), Check("first <= last")))
    df = made(spark, t, 800, null_rate=0.2)
    assert df.where("opens >= shuts or first > last").count() == 0 and df.where("opens is null").count() > 50
    circle = Table("t", (KEY, number("a"), number("b")), ("id",), checks=(Check("a < b"), Check("b < a"), Check("a >= 5")))
    assert made(spark, circle).where("a < 5").count() == 0  # none can hold; the rest does
    with pytest.raises(GenerationFailed, match="nothing lies"):
        made(spark, Table("t", (KEY, number("a")), ("id",), checks=(Check("a > 5 AND a < 6"),))).count()


def test_whole_steps():
    assert predicates.units(number("x"), Interval(0.5, 3, False, True)) == (1, 2)
    assert predicates.units(number("x", Kind.DECIMAL, precision=4, scale=2), Interval(0, 1, True, False)) == (1, 100)
    assert predicates.units(number("x", Kind.SMALLINT), Interval(None, 10**6)) == (None, 32767)


# --- times


def test_events_are_found_in_names():
    named = {"ordered_at": "ordered", "order_date": "order", "date_of_birth": "birth", "birthdate": "birth", "check_in": "checkin", "check_in_date": "checkin", "checkin_at": "checkin", "valid_until": "validuntil", "start_time": "start"}
    assert {n: vocabulary.event_of(n) for n in named} == named


@pytest.mark.parametrize(
    ("first", "then"),
    [
        ("start_date", "end_date"), ("start_at", "end_at"), ("started_at", "ended_at"), ("start_time", "end_time"), ("begin_date", "end_date"), ("begin_at", "end_at"), ("birth_date", "hire_date"), ("birth_date", "death_date"),
        ("birthdate", "hire_date"), ("date_of_birth", "hire_date"), ("date_of_birth", "date_of_death"), ("order_date", "ship_date"), ("order_date", "delivery_date"), ("ordered_at", "shipped_at"), ("ordered_at", "delivered_at"),
        ("ship_date", "delivery_date"), ("shipped_at", "delivered_at"), ("valid_from", "valid_to"), ("valid_from", "valid_until"), ("effective_from", "effective_to"), ("check_in", "check_out"), ("checkin_at", "checkout_at"),
        ("check_in_date", "check_out_date"), ("created_at", "updated_at"),
    ],
)
def test_pairs_are_ordered(first, then):
    t = Table("t", (Column(then, Kind.TIMESTAMP), Column(first, Kind.TIMESTAMP)))
    assert [(g.kind, dict(g.columns)) for g in coherence.detect(t)] == [("time", {"before": first, "after": then})]


@pytest.mark.parametrize("kinds", list(itertools.product((Kind.TIMESTAMP, Kind.DATE), repeat=2)))
def test_a_chain_and_a_branch_of_times(spark, kinds):
    a, b = kinds
    names = {"created_at": a, "paid_at": b, "shipped_at": a, "delivered_at": b, "ordered_at": a, "updated_at": b}
    t = Table("t", (KEY, *(Column(n, k, nullable=False) for n, k in names.items())), ("id",))
    df = made(spark, t, 2000)
    orders = [("created_at", "paid_at"), ("paid_at", "shipped_at"), ("shipped_at", "delivered_at"), ("ordered_at", "shipped_at"), ("ordered_at", "paid_at"), ("created_at", "updated_at"), ("created_at", "delivered_at")]
    wrong = " or ".join(f"cast({x} as timestamp) >= cast({y} as timestamp)" for x, y in orders)
    assert df.where(wrong).count() == 0
    rows = df.collect()
    # Branches aren't ordered, and values spread over the span.
    day = lambda v: v.date() if isinstance(v, dt.datetime) else v
    assert 0 < sum(day(r["updated_at"]) < day(r["delivered_at"]) for r in rows) < 2000
    assert len({day(r["created_at"]) for r in rows}) > 200


# --- zipf


@pytest.mark.parametrize("exponent", [0.5, 1.0, 2.0])
def test_zipf_draws_are_exact(spark, exponent):
    ranks, n = 3000, 4000
    high = np.cumsum(np.arange(1, ranks + 1.0) ** -exponent)
    high /= high[-1]
    df = spark.range(n).select("id", rng.uniform(1, "t", "c", F.col("id")).alias("u"))
    got = {r["id"]: (r["u"], r["rank"]) for r in rng.zipf_draws(df, "u", ranks, exponent).collect()}
    assert len(got) == n
    for u, rank in got.values():
        assert rank == np.searchsorted(high, u, side="right") + 1


def test_zipf_table_of_many_ranks_is_no_single_task(spark):
    table = rng.zipf_table(spark, 300_000)
    assert table.count() == 300_000
    last = table.orderBy(F.desc("rank")).first()
    assert abs(last["high"] - 1) < 1e-9 and table.where("high <= low").count() == 0
    plan = table._jdf.queryExecution().executedPlan().toString()
    spans = [x for x in plan.splitlines() if "SinglePartition" in x]
    assert len(spans) <= 1  # one row a block of ranks meets in one task


# --- names


@pytest.mark.parametrize(
    ("name", "kind", "generator"),
    [
        ("name", Kind.TEXT, "person.full_name"), ("fname", Kind.TEXT, "person.first_name"), ("lname", Kind.VARCHAR, "person.last_name"), ("birthday", Kind.DATE, "person.birth_date"), ("due_date", Kind.DATE, "time.end"),
        ("start_time", Kind.TIMESTAMP, "time.start"), ("end_time", Kind.TIMESTAMP, "time.end"), ("revenue", Kind.DECIMAL, "finance.amount"), ("profit", Kind.DECIMAL, "finance.amount"), ("barcode", Kind.TEXT, "commerce.isbn"),
        ("middlename", Kind.TEXT, "person.middle_name"), ("domain_name", Kind.TEXT, "internet.domain"), ("useragent", Kind.TEXT, "internet.user_agent"), ("foreign_key", Kind.TEXT, "internet.token"), ("image_uri", Kind.TEXT, "contact.url"),
        ("row_guid", Kind.TEXT, "identifier.uuid"), ("address_line_1", Kind.TEXT, "location.street"), ("neighborhood", Kind.TEXT, "location.county"), ("excerpt", Kind.TEXT, "text.paragraph"), ("featured", Kind.BOOLEAN, "boolean.coin"),
        ("deleted", Kind.BOOLEAN, "boolean.coin"), ("deleted", Kind.TIMESTAMP, "time.deleted"), ("date_created", Kind.TIMESTAMP, "time.created"), ("timezone", Kind.TEXT, "location.timezone"),
    ],
)
def test_names_say_what_fills_them(name, kind, generator):
    assert mapping.map_column(Column(name, kind), Table("zz", ())).generator == generator
