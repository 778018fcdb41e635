"""Generated tables keep keys, references, uniqueness and formats, on any number of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.errors import CircularDependency, EmptyReferencePool, UniqueExhausted
from rowloom.functions import rng
from rowloom.operators import cardinality, coherence, generate, mapping, plan, unique
from rowloom.operators.prefix import ordinals, rank_within, running_before
from rowloom.schema import Column, ForeignKey, Kind, Schema, Table, filter_schema, inspect, format_report

KEY = Column("id", Kind.INTEGER, nullable=False, auto_increment=True)


def ref(name, nullable=False):
    return Column(name, Kind.INTEGER, nullable=nullable)


def fk(column, table):
    return ForeignKey((column,), table, ("id",))


SHOP = Schema.of(
    Table("users", (KEY, Column("first_name", Kind.VARCHAR, nullable=False, max_length=50), Column("email", Kind.VARCHAR, nullable=False, max_length=60), Column("phone", Kind.VARCHAR, max_length=20), Column("is_verified", Kind.BOOLEAN, nullable=False), Column("created_at", Kind.TIMESTAMPTZ, nullable=False), Column("updated_at", Kind.TIMESTAMPTZ, nullable=False)), ("id",), (), (("email",),)),
    Table("categories", (KEY, Column("name", Kind.VARCHAR, nullable=False, max_length=60), ref("parent_id", True)), ("id",), (fk("parent_id", "categories"),), (("name",),)),
    Table("products", (Column("id", Kind.UUID, nullable=False), Column("price", Kind.DECIMAL, nullable=False, precision=10, scale=2), ref("category_id"), Column("sku", Kind.VARCHAR, nullable=False, max_length=20)), ("id",), (fk("category_id", "categories"),), (("sku",),)),
    Table("orders", (KEY, ref("user_id"), Column("status", Kind.ENUM, nullable=False, values=("new", "paid", "sent")), Column("notes", Kind.TEXT), Column("total", Kind.DECIMAL, generated=True)), ("id",), (fk("user_id", "users"),)),
    Table("order_items", (ref("order_id"), Column("product_id", Kind.UUID, nullable=False), Column("quantity", Kind.INTEGER, nullable=False)), ("order_id", "product_id"), (fk("order_id", "orders"), fk("product_id", "products"))),
    Table("profiles", (KEY, ref("user_id")), ("id",), (fk("user_id", "users"),), (("user_id",),)),
)
CONFIG = {"users": 120, "categories": 40, "products": 60, "orders": 300, "order_items": 500, "profiles": 100}


@pytest.fixture(scope="module")
def shop(spark):
    made = generate.generate(spark, SHOP, generate.Config(7, rows_of=CONFIG))
    return {k: v.cache() for k, v in made.tables.items()}


def test_counts_keys_and_references(shop):
    for k, n in CONFIG.items():
        df, t = shop[k], SHOP.tables[k]
        assert df.count() == n and df.select(*t.primary_key).distinct().count() == n
        for u in t.uniques:
            assert df.select(*u).distinct().count() == n
        for f in t.foreign_keys:
            lost = df.select(F.col(f.columns[0]).alias("k")).where("k is not null").join(shop[f.table].select(F.col("id").alias("k")), "k", "left_anti")
            assert lost.count() == 0
    assert "total" not in shop["orders"].columns


def test_values(shop):
    users = shop["users"].collect()
    assert all(r["updated_at"] >= r["created_at"] and r["email"].rsplit("@")[1].startswith("example.") for r in users)
    assert 0 < sum(r["phone"] is None for r in users) < 60
    assert {r["status"] for r in shop["orders"].collect()} == {"new", "paid", "sent"}
    roots = shop["categories"].where("parent_id is null").count()
    assert roots == 6 and shop["categories"].where("parent_id >= id").count() == 0
    assert shop["products"].where(~F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).count() == 0


def test_partitions_do_not_matter(spark):
    got = []
    for n in (1, 2, 7):
        t = generate.generate(spark, SHOP, generate.Config(7, rows_of=CONFIG, partitions=n)).tables
        got.append({k: sorted(map(str, t[k].collect())) for k in ("users", "orders", "order_items", "categories")})
    assert got[0] == got[1] == got[2]


def test_augmenting_existing_rows(spark):
    old = spark.createDataFrame([(5, "a"), (9, "b")], "id int, name string")
    s = Schema.of(Table("t", (KEY, Column("name", Kind.TEXT, nullable=False, values=("a", "b"))), ("id",), (), (("name",),)), Table("c", (KEY, ref("t_id")), ("id",), (fk("t_id", "t"),)))
    made = generate.generate(spark, s, generate.Config(1, rows_of={"t": 4, "c": 50}), {"t": old}).tables
    new = made["t"].collect()
    assert [r["id"] for r in sorted(new)] == [10, 11, 12, 13] and len({r["name"] for r in new} | {"a", "b"}) == 6
    assert {r["t_id"] for r in made["c"].collect()} <= {5, 9, 10, 11, 12, 13}


def test_empty_pools(spark):
    s = Schema.of(Table("p", (KEY,), ("id",)), Table("c", (KEY, ref("p_id")), ("id",), (fk("p_id", "p"),)))
    with pytest.raises(EmptyReferencePool):
        generate.generate(spark, s, generate.Config(rows_of={"p": 0, "c": 3}))
    assert generate.generate(spark, s, generate.Config(rows_of={"p": 0, "c": 0})).tables["c"].count() == 0


def test_plan_orders_and_breaks_cycles():
    p = plan.insert_plan(SHOP)
    assert p.ordered == ["categories", "products", "users", "orders", "order_items", "profiles"] and p.levels["order_items"] == 2
    a = Table("a", (KEY, ref("b_id", True)), ("id",), (fk("b_id", "b"),))
    b = Table("b", (KEY, ref("c_id")), ("id",), (fk("c_id", "c"),))
    c = Table("c", (KEY, ref("a_id")), ("id",), (fk("a_id", "a"),))
    p = plan.insert_plan(Schema.of(a, b, c))
    assert p.ordered == ["a", "c", "b"] and [(e.child, e.parent) for e in p.deferred] == [("a", "b")]
    assert plan.cycles(["a", "b", "c"], plan.edges_of(Schema.of(a, b, c))) == [("a", "b", "c")]
    with pytest.raises(CircularDependency):
        plan.insert_plan(Schema.of(Table("a", (KEY, ref("b_id")), ("id",), (fk("b_id", "b"),)), Table("b", (KEY, ref("a_id")), ("id",), (fk("a_id", "a"),))))


def sequential(shares, total, low, high):
    """The allocation as a loop."""
    half = lambda x: int(x + 0.5)
    n = len(shares)
    c = [half(low + s * (high - low)) for s in shares]
    if sum(c) == 0:
        return [total // n + (i < total % n) for i in range(n)]
    if sum(c) != total:
        s = sum(c)
        c = [half(x * total / s) for x in c]
    i = 0
    while sum(c) < total:
        if i < n and c[i] < high:
            c[i] += 1
        elif i < n - 1:
            i += 1
        else:
            c[0] += 1
    for floor in (low, 0):
        i = 0
        while sum(c) > total and i < n:
            if c[i] > floor:
                c[i] -= 1
            else:
                i += 1
    return c


def test_allocation_equals_the_loop(spark):
    r = random.Random(3)
    for _ in range(12):
        n, low = r.randint(1, 40), r.randint(0, 4)
        high, total = low + r.randint(0, 6), r.randint(1, 300)
        shares = [r.random() for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(shares)), "ord long, share double")
        got = [x["n_children"] for x in cardinality.allocate(df, total, cardinality.Cardinality(low, high)).orderBy("ord").collect()]
        assert got == sequential(shares, total, low, high)


def test_prefix_sums_and_ranks(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = running_before(df, "v", "id", "b", span=16).orderBy("id").collect()
    assert [x["b"] for x in got] == [sum(i % 7 for i in range(k)) for k in range(500)]
    ranks = rank_within(df, ("v",), "id", "k", span=16).collect()
    assert all(x["k"] == x["id"] // 7 for x in ranks)
    o = ordinals(df.repartition(5).select("id"), ["id"]).collect()
    assert all(x["ord"] == x["id"] for x in o)


def test_unique_resolution(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a_1"), (3, None), (4, None)], "i long, v string")
    got = [x["v"] for x in unique.resolve(df, "v", "i").orderBy("i").collect()]
    assert got[0] == "a" and len(set(got[:3])) == 3 and got[3:] == [None, None]
    mail = spark.createDataFrame([(i, "x@e.org") for i in range(12)], "i long, v string")
    got = [x["v"] for x in unique.resolve(mail, "v", "i", "email", max_length=10).collect()]
    assert len(set(got)) == 12 and all(len(x) <= 10 for x in got)
    tight = spark.createDataFrame([(i, "zz") for i in range(300)], "i long, v string")
    with pytest.raises(UniqueExhausted):
        unique.resolve(tight, "v", "i", max_length=2)


def test_distributions(spark):
    rows = spark.range(4000)
    mean = lambda kind: rows.select(rng.share(kind, 1, "t", "c", F.col("id"), 4000).alias("x")).agg(F.avg("x"), F.min("x"), F.max("x")).first()
    assert abs(mean("uniform")[0] - 0.5) < 0.03 and abs(mean("normal")[0] - 0.5) < 0.02 and mean("exponential")[0] < 0.45 and mean("zipf")[0] < 0.2
    assert all(0 <= mean(k)[1] and mean(k)[2] <= 1 for k in rng.DISTRIBUTIONS)


def test_mapping():
    t = Table("users", (), ())
    how = lambda name, kind=Kind.VARCHAR, **k: mapping.map_column(Column(name, kind, **k), t)
    assert how("user_email").generator == "contact.email" and how("EMAIL").source == "name" and how("billing_city").source == "suffix"
    assert how("is_active", Kind.BOOLEAN).source == "prefix" and how("is_active", Kind.INTEGER).source != "prefix"
    assert how("x", values=("a",)).source == "enum" and how("n", auto_increment=True).source == "skip" and how("email", Kind.JSON).source == "shortcut"
    assert how("patient").source == "stem" and how("zzz").source == "type"


def test_filter_and_report(spark):
    r = filter_schema(SHOP, ["order_items"], ["prod*"])
    assert set(r.schema.tables) == {"order_items", "orders", "users", "categories"} and r.auto_included == ["categories", "orders", "users"]
    assert [f.table for f in r.schema.tables["order_items"].foreign_keys] == ["orders"]
    got = {x["table"]: x for x in inspect(spark, SHOP).collect()}
    assert got["users"]["referenced_by"] == 2 and got["order_items"]["references"] == 2
    assert "order_items" in format_report(inspect(spark, SHOP))


def test_coherent_groups(spark):
    t = Table("people", tuple(Column(c) for c in ("first_name", "last_name", "gender", "city", "state", "zip_code")) + (Column("birth_date", Kind.DATE), Column("hire_date", Kind.DATE)))
    assert [g.kind for g in coherence.detect(t)] == ["person", "place", "time"]
    df = generate.generate(spark, Schema.of(t), generate.Config(3, rows=200, null_rate=0.0)).tables["people"].collect()
    from rowloom.functions.values import FIRST_F, PLACES

    assert all((r["first_name"] in FIRST_F) == (r["gender"] == "female") and r["hire_date"] >= r["birth_date"] for r in df)
    assert {(r["city"], r["state"], r["zip_code"][:3]) for r in df} <= set(PLACES)


def test_stream_equals_batch(spark):
    from rowloom.streaming.generator import project, stream_table

    t, c = SHOP.tables["users"], generate.Config(7, null_rate=0.0)
    q = stream_table(spark, t, c, 200).writeStream.format("memory").queryName("s_users").start()
    try:
        import time

        for _ in range(60):
            q.processAllAvailable()
            if spark.sql("select * from s_users").count() >= 50:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = {r["id"]: r["first_name"] for r in spark.sql("select * from s_users").collect()}
    want = {r["id"]: r["first_name"] for r in project(spark.range(len(got)).select(F.col("id").alias("__row")), t, c).collect()}
    assert len(got) >= 50 and got == want
