"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import diff
from ..functions import names, rng
from ..functions.names import normalise_column
from ..functions.rng import sql_uniform as U
from ..functions.values import PLACES, SAFE_DOMAINS, Ctx, address, ipv4, uuid4
from ..operators import cardinality, coherence, existing, generate, mapping, plan, unique, vocabulary
from ..operators.prefix import ordinals
from ..schema import Check, Column, ForeignKey, Kind, Schema, Table, ancestors, columns_frame, edges_frame, excluded, filter_schema, glob_regex, table_from_frame
from ..scratch import materialise
from ..sinks import sqltext
from ..sources import introspect
from ..sources.catalog import literals_column

SEED, REF = 42, 1735689600
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"),
]
PRIMARY = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "events": "event_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id"}
SEGMENTS = ["new", "paid", "sent", "done"]


def read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def given_schema(spark: SparkSession, d: str) -> Schema:
    fks = lambda t: tuple(ForeignKey((c,), p, (r,), virtual=True) for x, c, p, r in KEYS if x == t)
    return Schema.of(*(table_from_frame(t, read(spark, d, t), (PRIMARY[t],) if t in PRIMARY else (), fks(t)) for t in TABLES))


def rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"))


def keys(spark: SparkSession, d: str) -> DataFrame:
    """Orders by their key, as rows that values are drawn for."""
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("row"))


def n_rows(spark: SparkSession, d: str, t: str) -> int:
    return read(spark, d, t).count()


def distinct(spark: SparkSession, d: str, t: str, column: str) -> tuple[str, ...]:
    """A column's values, of which there are a few dozen at most whatever the scale (priorities, segments, brands)."""
    return tuple(sorted(r[0] for r in existing.distinct_values(read(spark, d, t), column).collect()))


ROW = Column("row", Kind.BIGINT, nullable=False)


def generated(spark: SparkSession, table: Table, n: int) -> DataFrame:
    """n rows of one table that starts with its row number."""
    config = generate.Config(SEED, rows=n, overrides={table.name: {"row": {"builder": lambda c: c.row}}})
    return generate.generate(spark, Schema.of(table), config).tables[table.name]


def u(table: str, column: str, row="row", draw=0):
    return rng.uniform(SEED, table, column, F.col(row), draw)


def micros(x, digits: int = 6):
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)).cast("long")


def sql_micros(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5)::BIGINT"


def augment_orders(spark: SparkSession, d: str) -> DataFrame:
    """100 more orders: next keys, sampled customers, prices, statuses."""
    orders, customer = read(spark, d, "orders"), read(spark, d, "customer")
    schema = Schema.of(
        Table("customer", (Column("c_custkey", Kind.BIGINT),), ("c_custkey",)),
        Table("orders", (Column("o_orderkey", Kind.BIGINT, auto_increment=True, nullable=False), Column("o_custkey", Kind.BIGINT, nullable=False), Column("o_status", Kind.TEXT, nullable=False, values=tuple(SEGMENTS)), Column("o_cents", Kind.BIGINT, nullable=False)), ("o_orderkey",), (ForeignKey(("o_custkey",), "customer", ("c_custkey",)),)),
    )
    cents = {"builder": lambda c: rng.between(c.u(), 100, 999999)}
    config = generate.Config(SEED, rows_of={"customer": 0, "orders": 100}, null_rate=0.0, ref=REF, overrides={"orders": {"o_cents": cents}})
    return generate.generate(spark, schema, config, {"customer": customer, "orders": orders}).tables["orders"]


Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


Q["augment_orders"] = augment_orders
S["augment_orders"] = f"""
    WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer), n AS (SELECT count(*) AS n FROM customer), m AS (SELECT max(o_orderkey) + 1 AS nxt FROM orders)
    SELECT m.nxt + i AS o_orderkey, c.c_custkey AS o_custkey, (['new','paid','sent','done'])[(floor({U(SEED, 'orders', 'o_status', 'i')} * 4) + 1)::INT] AS o_status,
           (floor({U(SEED, 'orders', 'o_cents', 'i')} * 999900) + 100)::BIGINT AS o_cents
    FROM range(100) r(i), n, m JOIN c ON c.ord = floor({U(SEED, 'orders', 'o_custkey', 'i')} * n.n)::BIGINT"""


# --- existing data


@query("UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t} " for t in TABLES))
def existing_row_counts(spark, d):
    return existing.row_counts({t: read(spark, d, t) for t in TABLES})


@query("SELECT max(o_orderkey) AS max_key, count(*) AS n_rows FROM orders")
def existing_max_pk(spark, d):
    got = existing.read_existing(Table("orders", (Column("o_orderkey", Kind.BIGINT, auto_increment=True),), ("o_orderkey",)), read(spark, d, "orders"))
    return spark.createDataFrame([(got.next_key["o_orderkey"] - 1, got.rows)], "max_key long, n_rows long")


@query("SELECT DISTINCT p_brand::VARCHAR AS value FROM part WHERE p_brand IS NOT NULL")
def existing_distinct_values(spark, d):
    return existing.distinct_values(read(spark, d, "part"), "p_brand")


@query("SELECT 'o_orderkey' AS \"column\", COALESCE(max(o_orderkey), 1)::BIGINT AS value FROM orders UNION ALL SELECT 'o_custkey', COALESCE(max(o_custkey), 1)::BIGINT FROM orders")
def sequence_reset_values(spark, d):
    return sqltext.sequence_values(read(spark, d, "orders"), ["o_orderkey", "o_custkey"])


# --- random numbers and distributions


@query(f"SELECT i AS row, {sql_micros(U(SEED, 't', 'c', 'i'), 9)} AS u FROM (SELECT o_orderkey AS i FROM orders) r")
def uniform_draw(spark, d):
    return keys(spark, d).select("row", micros(u("t", "c"), 9).alias("u"))


@query("SELECT (SELECT max(o_orderkey) FROM orders) + 1 + i AS id FROM range(500) r(i)")
def auto_increment_ids(spark, d):
    s = Schema.of(Table("orders", (Column("o_orderkey", Kind.BIGINT, auto_increment=True, nullable=False),), ("o_orderkey",)))
    made = generate.generate(spark, s, generate.Config(SEED, rows=500), {"orders": read(spark, d, "orders")})
    return made.tables["orders"].select(F.col("o_orderkey").alias("id"))


_N = f"least(1.0, greatest(0.0, 0.5 + 0.15 * sqrt(-2.0 * ln(greatest({U(SEED, 't', 'n', 'i', 0)}, 1e-12))) * cos(2 * pi() * {U(SEED, 't', 'n', 'i', 1)})))"


@query(f"SELECT i AS row, {sql_micros(_N)} AS x FROM (SELECT o_orderkey AS i FROM orders) r")
def dist_normal(spark, d):
    return keys(spark, d).select("row", micros(rng.share("normal", SEED, "t", "n", F.col("row"), 1000)).alias("x"))


@query(f"SELECT i AS row, {sql_micros(f'-ln(1.0 - {U(SEED, chr(116), chr(101), chr(105))} * (1.0 - exp(-1.0)))')} AS x FROM (SELECT o_orderkey AS i FROM orders) r")
def dist_exponential(spark, d):
    return keys(spark, d).select("row", micros(rng.share("exponential", SEED, "t", "e", F.col("row"), 1000)).alias("x"))


@query(f"""WITH p AS (SELECT k, 1.0 / k AS p FROM range(1, (SELECT count(*) FROM customer) + 1) r(k)), c AS (SELECT k, coalesce(sum(p) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(p) FROM p) AS lo FROM p),
    d AS (SELECT o_orderkey AS i, {U(SEED, 't', 'z', 'o_orderkey')} AS u FROM orders)
    SELECT d.i AS row, c.k AS rank FROM d ASOF JOIN c ON d.u >= c.lo""")
def dist_zipf_rank(spark, d):
    """A customer's rank for each order, by the exact cumulative shares."""
    return rng.zipf_draws(keys(spark, d).withColumn("u", u("t", "z")), "u", n_rows(spark, d, "customer")).select("row", "rank")


@query(f"SELECT i AS row, least(1000, greatest(1, floor(exp({U(SEED, 't', 'zc', 'i')} * ln(1001.0)))))::BIGINT AS rank FROM (SELECT o_orderkey AS i FROM orders) r")
def dist_zipf_continuous(spark, d):
    return keys(spark, d).select("row", rng.zipf_rank(u("t", "zc"), 1000).alias("rank"))


# --- graph


@query(" UNION ALL ".join(f"SELECT '{a}' AS child, '{p}' AS parent, '{c}' AS columns" for a, c, p, _ in KEYS))
def fk_edges(spark, d):
    return edges_frame(spark, given_schema(spark, d)).select("child", "parent", "columns")


_E = "e(child, parent) AS (VALUES " + ", ".join(f"('{a}', '{p}')" for a, _, p, _ in KEYS) + ")"
_T = "t(name) AS (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ")"


@query(f"WITH {_E}, {_T} SELECT name, (SELECT count(*) FROM e WHERE child = name) AS outgoing, (SELECT count(*) FROM e WHERE parent = name) AS incoming FROM t")
def fk_in_out_degree(spark, d):
    s = given_schema(spark, d)
    edges = edges_frame(spark, s)
    names_ = spark.createDataFrame([(t,) for t in s.tables], "name string")
    out = edges.groupBy(F.col("child").alias("name")).agg(F.count("*").alias("outgoing"))
    into = edges.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("incoming"))
    return names_.join(out, "name", "left").join(into, "name", "left").na.fill(0)


@query(f"WITH RECURSIVE {_E}, {_T}, w AS (SELECT name, 0 AS lvl FROM t UNION SELECT e.child, w.lvl + 1 FROM w JOIN e ON e.parent = w.name) SELECT name, max(lvl)::BIGINT AS level FROM w GROUP BY name")
def topo_levels(spark, d):
    made = plan.insert_plan(given_schema(spark, d))
    return spark.createDataFrame(sorted(made.levels.items()), "name string, level long")


@query(f"WITH RECURSIVE {_E}, w AS (SELECT parent AS name FROM e WHERE child = 'lineitem' UNION SELECT e.parent FROM w JOIN e ON e.child = w.name) SELECT name FROM w")
def ancestor_closure(spark, d):
    """The tables that lineitem references, directly or not."""
    return spark.createDataFrame([(n,) for n in sorted(ancestors(given_schema(spark, d), ["lineitem"]))], "name string")


# --- foreign keys


@query(f"""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer)
    SELECT o.o_orderkey, c.c_custkey AS sampled FROM orders o JOIN c ON c.ord = floor({U(SEED, 'orders', 'o_custkey', 'o.o_orderkey')} * (SELECT count(*) FROM customer))::BIGINT""")
def fk_assign_uniform(spark, d):
    customer = read(spark, d, "customer")
    pool = ordinals(customer.select("c_custkey"), ["c_custkey"])
    at = generate.parent_ordinal(SEED, "orders", ("o_custkey",), F.col("o_orderkey"), customer.count())
    return read(spark, d, "orders").select("o_orderkey", at.alias("at")).join(pool, F.col("at") == F.col("ord")).select("o_orderkey", F.col("c_custkey").alias("sampled"))


@query(f"""WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), o AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS ord FROM k)
    SELECT i AS row, o.l_orderkey, o.l_linenumber FROM range(1000) r(i) JOIN o ON o.ord = floor({U(SEED, 'returns', 'l_orderkey+l_linenumber', 'i')} * (SELECT count(*) FROM k))::BIGINT""")
def fk_assign_composite(spark, d):
    keys = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    pool = ordinals(keys, ["l_orderkey", "l_linenumber"])
    at = generate.parent_ordinal(SEED, "returns", ("l_orderkey", "l_linenumber"), F.col("row"), keys.count())
    return rows(spark, 1000).withColumn("at", at).join(pool, F.col("at") == F.col("ord")).select("row", "l_orderkey", "l_linenumber")


@query("SELECT i AS row, true AS without_parent FROM range((SELECT count(*) FROM customer)) r(i)")
def fk_assign_nullable_pool(spark, d):
    s = Schema.of(Table("p", (Column("id", Kind.BIGINT, nullable=False, auto_increment=True),), ("id",)), Table("c", (Column("row", Kind.BIGINT, nullable=False), Column("parent_id", Kind.BIGINT)), (), (ForeignKey(("parent_id",), "p", ("id",)),)))
    config = generate.Config(SEED, rows_of={"p": 0, "c": n_rows(spark, d, "customer")}, overrides={"c": {"row": {"builder": lambda x: x.row}}})
    return generate.generate(spark, s, config).tables["c"].select("row", F.col("parent_id").isNull().alias("without_parent"))


_ORPHANS = " UNION ALL ".join(f"SELECT '{a}.{c}' AS key, count(*) AS orphans FROM {a} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{r} = x.{c})" for a, c, p, r in KEYS)


@query(_ORPHANS)
def fk_orphan_check(spark, d):
    out = None
    for a, c, p, r in KEYS:
        lost = read(spark, d, a).select(F.col(c).alias("k")).where("k is not null").join(read(spark, d, p).select(F.col(r).alias("k")), "k", "left_anti")
        one = lost.agg(F.count("*").alias("orphans")).select(F.lit(f"{a}.{c}").alias("key"), "orphans")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT n, count(*) AS parents FROM (SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1) GROUP BY n")
def fk_children_histogram(spark, d):
    per = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return read(spark, d, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n")).groupBy("n").agg(F.count("*").alias("parents"))


# --- cardinality

_ALLOC = """, s AS (SELECT count(*) AS p, sum(c) AS s FROM a),
    b AS (SELECT ord, floor(c * {T}::DOUBLE / s.s + 0.5)::BIGINT AS c FROM a, s), g AS (SELECT {T} - sum(c)::BIGINT AS gap FROM b),
    up AS (SELECT ord, c, greatest({HI} - c, 0) AS cap, greatest(c - {LO}, 0) AS cut FROM b),
    pre AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pu, coalesce(sum(cut) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pd FROM up),
    f AS (SELECT ord, c + CASE WHEN gap > 0 THEN least(cap, greatest(gap - pu, 0)) + CASE WHEN ord = 0 THEN greatest(gap - (SELECT sum(cap) FROM up), 0) ELSE 0 END WHEN gap < 0 THEN -least(cut, greatest(-gap - pd, 0)) ELSE 0 END AS c1, gap FROM pre, g),
    k AS (SELECT f.ord, c1, c1 AS cap2, (gap + (SELECT sum(cut) FROM up)) AS left_ FROM f),
    z AS (SELECT ord, CASE WHEN left_ < 0 THEN c1 - least(cap2, greatest(-left_ - coalesce(sum(cap2) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) ELSE c1 END AS c FROM k)
    SELECT ord, c::BIGINT AS n_children FROM z"""


def _allocated(spark, d, kind, low, high, total):
    n = read(spark, d, "customer").count()
    parents = spark.range(n).select(F.col("id").alias("ord")).withColumn("share", rng.share(kind, SEED, "orders", "o_custkey#", F.col("ord"), n))
    return cardinality.allocate(parents, total, cardinality.Cardinality(low, high, kind)).select("ord", "n_children")


def _alloc_sql(share: str, low: int, high: int, total: int) -> str:
    return f"WITH a AS (SELECT i AS ord, floor({low} + ({share}) * {high - low} + 0.5)::BIGINT AS c FROM range((SELECT count(*) FROM customer)) r(i))" + _ALLOC.format(T=total, LO=low, HI=high)


_UC = U(SEED, "orders", "o_custkey#", "i")


@query(_alloc_sql(_UC, 1, 9, 9000))
def cardinality_uniform(spark, d):
    return _allocated(spark, d, "uniform", 1, 9, 9000)


@query(_alloc_sql(f"least(1.0, greatest(0.0, 0.5 + 0.15 * sqrt(-2.0 * ln(greatest({_UC}, 1e-12))) * cos(2 * pi() * {U(SEED, 'orders', 'o_custkey#', 'i', 1)})))", 2, 6, 5000))
def cardinality_normal(spark, d):
    return _allocated(spark, d, "normal", 2, 6, 5000)


@query(_alloc_sql(f"(least(greatest((SELECT count(*) FROM customer), 100), greatest(1, floor(exp({_UC} * ln(greatest((SELECT count(*) FROM customer), 100) + 1.0))))) - 1) / (greatest((SELECT count(*) FROM customer), 100) - 1.0)", 0, 40, 7000))
def cardinality_zipf(spark, d):
    return _allocated(spark, d, "zipf", 0, 40, 7000)


@query("SELECT i AS ord, (1000 // (SELECT count(*) FROM customer) + CASE WHEN i < 1000 % (SELECT count(*) FROM customer) THEN 1 ELSE 0 END)::BIGINT AS n_children FROM range((SELECT count(*) FROM customer)) r(i)")
def cardinality_zero_sum(spark, d):
    return _allocated(spark, d, "uniform", 0, 0, 1000)


@query("SELECT c_nationkey::BIGINT AS parent, count(*) AS n FROM customer GROUP BY 1")
def cardinality_sequence(spark, d):
    """Nations with as many children as they have customers, expanded to rows and counted again."""
    parents = ordinals(read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("parent")).agg(F.count("*").alias("n_children")), ["parent"])
    each = cardinality.expand(parents, SEED, "customer", "c_nationkey", ["parent"])
    return each.groupBy("parent").agg(F.countDistinct("child_ord").alias("n"))


# --- columns


@query(f"SELECT o_orderkey, CASE WHEN {U(SEED, 'orders', 'note?', 'o_orderkey')} >= 0.1 THEN o_orderpriority END AS note FROM orders")
def null_injection(spark, d):
    t = Table("orders", (Column("note", Kind.TEXT),))
    maker = generate.Generator(spark, Schema.of(t), generate.Config(SEED))
    return read(spark, d, "orders").select("o_orderkey", maker.with_nulls(F.col("o_orderpriority"), t.column("note"), t, F.col("o_orderkey")).alias("note"))


@query(f"SELECT i AS row, p.v[(floor({U(SEED, 'orders', 'status', 'i')} * len(p.v)) + 1)::INT] AS status FROM range((SELECT count(*) FROM orders)) r(i), (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS v FROM orders) p")
def enum_pick(spark, d):
    return generated(spark, Table("orders", (ROW, Column("status", Kind.ENUM, nullable=False, values=distinct(spark, d, "orders", "o_orderpriority")))), n_rows(spark, d, "orders"))


_W = U(SEED, "orders", "w", "i")


@query(f"SELECT i AS row, CASE WHEN {_W} < 0.5 THEN 'a' WHEN {_W} < 0.8 THEN 'b' ELSE 'c' END AS v FROM (SELECT o_orderkey AS i FROM orders) r")
def weighted_values(spark, d):
    return keys(spark, d).select("row", rng.weighted(u("orders", "w"), ["a", "b", "c"], [5, 3, 2]).alias("v"))


@query("SELECT i AS row, (['x','y','z'])[(i % 3 + 1)::INT] AS v, ((i * 2654435761) % 1000)::BIGINT AS place FROM (SELECT o_orderkey AS i FROM orders) r")
def cyclic_values(spark, d):
    return keys(spark, d).select("row", rng.cyclic(F.col("row"), ["x", "y", "z"]).alias("v"), (rng.spread(F.col("row")) * 1000 + 0.5).cast("long").alias("place"))


_A = f"({REF} - floor({U(SEED, 'orders', 'created_at', 'i', 0)} * 63072000)::BIGINT)"


@query(f"SELECT i AS row, {_A} AS created, {_A} + floor({U(SEED, 'orders', 'updated_at', 'i', 1)} * ({REF} - {_A}))::BIGINT AS updated FROM (SELECT o_orderkey AS i FROM orders) r")
def timestamp_pairs(spark, d):
    a, b = coherence.time_pair(SEED, "orders", "created_at", "updated_at", F.col("row"), REF)
    return keys(spark, d).select("row", a.alias("created"), b.alias("updated"))


@query(f"SELECT p_partkey, floor({U(SEED, 'part', 'price', 'p_partkey')} * 999999 * 100)::BIGINT AS cents FROM part")
def decimal_precision(spark, d):
    x = Ctx(SEED, "part", "price", F.col("p_partkey"), REF)
    value = mapping.fallback(Column("price", Kind.DECIMAL, precision=10, scale=2))(x).cast("decimal(10,2)")
    return read(spark, d, "part").select("p_partkey", (value * 100).cast("long").alias("cents"))


@query("SELECT p_partkey, rtrim(substr(p_name, 1, 7)) AS name FROM part")
def truncate_varchar(spark, d):
    t = Table("part", (Column("name", Kind.VARCHAR, max_length=7),))
    maker = generate.Generator(spark, Schema.of(t), generate.Config(SEED, overrides={"part": {"name": {"builder": lambda c: F.col("p_name")}}}))
    return read(spark, d, "part").select("p_partkey", maker.value(t.column("name"), t, mapping.map_column(t.column("name"), t), F.col("p_partkey")).alias("name"))


_H = f"md5('{SEED}|t|id|' || i || '|0')"


@query(f"SELECT i AS row, substr({_H},1,8) || '-' || substr({_H},9,4) || '-4' || substr({_H},14,3) || '-' || (['8','9','a','b'])[(floor({U(SEED, 't', 'id', 'i', 1)} * 4) + 1)::INT] || substr({_H},18,3) || '-' || substr({_H},21,12) AS id FROM (SELECT o_orderkey AS i FROM orders) r")
def uuid_v4_format(spark, d):
    return keys(spark, d).select("row", uuid4(Ctx(SEED, "t", "id", F.col("row"), REF)).alias("id"))


@query(f"SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@' || ({SAFE_DOMAINS!r})[(floor({U(SEED, 'customer', 'email', 'c_custkey', 2)} * 3) + 1)::INT] AS email FROM customer")
def safe_email(spark, d):
    local = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")))
    return read(spark, d, "customer").select("c_custkey", address(local, Ctx(SEED, "customer", "email", F.col("c_custkey"), REF)).alias("email"))


_P = f"(floor({U(SEED, 'people', '__place', 'i')} * {len(PLACES)}) + 1)::INT"


@query(f"SELECT i AS row, ({[p[0] for p in PLACES]!r})[{_P}] AS city, ({[p[1] for p in PLACES]!r})[{_P}] AS state, ({[p[2] for p in PLACES]!r})[{_P}] || lpad(floor({U(SEED, 'people', '__place', 'i', 1)} * 100)::BIGINT::VARCHAR, 2, '0') AS zip FROM (SELECT o_orderkey AS i FROM orders) r")
def coherent_location(spark, d):
    t = Table("people", tuple(Column(c) for c in ("city", "state", "zip")))
    made = coherence.columns_of(coherence.detect(t)[0], Ctx(SEED, "people", "", F.col("row"), REF))
    return keys(spark, d).select("row", *[v.alias(c) for c, v in made.items()])


@query("SELECT count(*) AS n_rows, 0::BIGINT AS violations FROM orders")
def temporal_coherence(spark, d):
    t = Table("ship", (Column("order_date", Kind.TIMESTAMP), Column("ship_date", Kind.TIMESTAMP)))
    made = coherence.columns_of(coherence.detect(t)[0], Ctx(SEED, "ship", "", F.col("row"), REF))
    return keys(spark, d).select(*[v.alias(c) for c, v in made.items()]).agg(F.count("*").alias("n_rows"), F.count_if(F.col("ship_date") < F.col("order_date")).alias("violations"))


@query(f"SELECT i AS row, {U(SEED, 't', 'flag', 'i')} < 0.5 AS flag FROM range((SELECT count(*) FROM orders)) r(i)")
def bool_flip(spark, d):
    return generated(spark, Table("t", (ROW, Column("flag", Kind.BOOLEAN, nullable=False))), n_rows(spark, d, "orders"))


_IP = " || '.' || ".join(f"(floor({U(SEED, 't', 'ip', 'i', k)} * {254 if k in (0, 3) else 255}) + {1 if k in (0, 3) else 0})::BIGINT" for k in range(4))
_M = f"md5('{SEED}|t|mac|' || i || '|0')"


@query(f"SELECT i AS row, {_IP} AS ip, " + " || ':' || ".join(f"substr({_M}, {1 + 2 * k}, 2)" for k in range(6)) + " AS mac FROM (SELECT o_orderkey AS i FROM orders) r")
def ipv4_mac(spark, d):
    return keys(spark, d).select("row", ipv4(Ctx(SEED, "t", "ip", F.col("row"), REF)).alias("ip"), mapping.fallback(Column("mac", Kind.MACADDR))(Ctx(SEED, "t", "mac", F.col("row"), REF)).alias("mac"))


# --- uniqueness


@query("WITH r AS (SELECT c_custkey, c_mktsegment AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer) SELECT c_custkey, CASE WHEN k > 0 THEN v || '_' || k ELSE v END AS v FROM r")
def unique_suffix(spark, d):
    return unique.one_pass(read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("v")), "v", "c_custkey").select("c_custkey", "v")


@query("""WITH t AS (SELECT DISTINCT l_linestatus AS v FROM lineitem),
    r AS (SELECT o_orderkey, o_orderstatus AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 + CASE WHEN o_orderstatus IN (SELECT v FROM t) THEN 1 ELSE 0 END AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k > 0 THEN v || '_' || k ELSE v END AS v FROM r""")
def unique_against_table(spark, d):
    """Values made unique among themselves and against those that a whole table holds."""
    new = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return unique.one_pass(new, "v", "o_orderkey", existing=read(spark, d, "lineitem").select("l_linestatus")).select("o_orderkey", "v")


@query("WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS v FROM lineitem), n AS (SELECT v, row_number() OVER (PARTITION BY v) - 1 AS k FROM r) SELECT v + k AS v, count(*) AS n FROM n GROUP BY 1")
def unique_number_bump(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("v"))
    numbered = ordinals(li, ["v"], "at")
    return unique.one_pass(numbered, "v", "at", "number").groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return unique.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS n_rows, count(*) AS n_pairs, 0::BIGINT AS out_of_range FROM lineitem")
def composite_unique(spark, d):
    """As many pairs of a customer and a part as there are lines."""
    left, right = n_rows(spark, d, "customer"), n_rows(spark, d, "part")
    a, b = unique.pair_ordinals(F.col("row"), left, right, SEED)
    pairs = rows(spark, n_rows(spark, d, "lineitem")).select(a.alias("a"), b.alias("b"))
    return pairs.agg(F.count("*").alias("n_rows"), F.countDistinct("a", "b").alias("n_pairs"), F.count_if((F.col("a") >= left) | (F.col("b") >= right) | (F.col("a") < 0) | (F.col("b") < 0)).alias("out_of_range"))


# --- deferral


@query(f"SELECT i AS row, CASE WHEN i >= floor(0.15::DOUBLE * (SELECT count(*) FROM customer)) AND i > 0 THEN floor({U(SEED, 'categories', 'parent_id', 'i')} * i)::BIGINT ELSE -1 END AS parent FROM range((SELECT count(*) FROM customer)) r(i)")
def self_ref_tree(spark, d):
    n = n_rows(spark, d, "customer")
    return rows(spark, n).select("row", F.coalesce(generate.tree_parent(SEED, "categories", "parent_id", F.col("row"), n), F.lit(-1)).alias("parent"))


@query("SELECT greatest(floor(0.15::DOUBLE * count(*)), 1)::BIGINT AS roots, 0::BIGINT AS forward, count(*) AS n_rows FROM part")
def self_ref_roots(spark, d):
    s = Schema.of(Table("categories", (Column("id", Kind.INTEGER, nullable=False, auto_increment=True), Column("parent_id", Kind.INTEGER)), ("id",), (ForeignKey(("parent_id",), "categories", ("id",)),)))
    t = generate.generate(spark, s, generate.Config(SEED, rows=n_rows(spark, d, "part"))).tables["categories"]
    return t.agg(F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("parent_id") >= F.col("id")).alias("forward"), F.count("*").alias("n_rows"))


def _cycle() -> Schema:
    key = lambda n: Column(n, Kind.INTEGER, nullable=False, auto_increment=True)
    return Schema.of(
        Table("orders", (key("id"), Column("invoice_id", Kind.INTEGER)), ("id",), (ForeignKey(("invoice_id",), "invoices", ("id",)),)),
        Table("invoices", (key("id"), Column("order_id", Kind.INTEGER, nullable=False)), ("id",), (ForeignKey(("order_id",), "orders", ("id",)),)),
    )


@query(f"SELECT i + 1 AS id, floor({U(SEED, 'orders', 'invoice_id', 'i')} * (SELECT count(*) FROM customer))::BIGINT + 1 AS invoice_id FROM range((SELECT count(*) FROM orders)) r(i)")
def cycle_fill(spark, d):
    made = generate.generate(spark, _cycle(), generate.Config(SEED, rows_of={"orders": n_rows(spark, d, "orders"), "invoices": n_rows(spark, d, "customer")}))
    return made.tables["orders"].select(F.col("id").cast("long").alias("id"), F.col("invoice_id").cast("long").alias("invoice_id"))


@query(f"SELECT i + 1 AS id, floor({U(SEED, 'orders', 'invoice_id', 'i')} * (SELECT count(*) FROM customer))::BIGINT + 1 AS invoice_id FROM range((SELECT count(*) FROM orders)) r(i)")
def deferred_apply(spark, d):
    """The same references as updates joined to rows that lack them."""
    made = generate.generate(spark, _cycle(), generate.Config(SEED, rows_of={"orders": n_rows(spark, d, "orders"), "invoices": n_rows(spark, d, "customer")}))
    updates = made.updates["orders"][0]
    bare = made.tables["orders"].select("id")
    return bare.join(updates, "id", "left").select(F.col("id").cast("long").alias("id"), F.col("invoice_id").cast("long").alias("invoice_id"))


# --- mapping and metadata

_COLUMNS = "c AS (SELECT table_name AS t, column_name AS c, ordinal_position - 1 AS p FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + "))"


@query(f"""WITH {_COLUMNS}, n AS (SELECT upper(t) || '--' || c || '_val' AS n FROM c UNION SELECT '__' || c || '__' || t || '_Field' FROM c UNION SELECT c FROM c)
    SELECT n AS name, regexp_replace(regexp_replace(regexp_replace(replace(lower(n), '-', '_'), '_+', '_', 'g'), '^_|_$', '', 'g'), '_(col|field|val|value)$', '') AS normalised FROM n""")
def normalize_column_names(spark, d):
    """The given tables' columns, written in odd ways."""
    c = columns_frame(spark, given_schema(spark, d))
    named = c.select(F.explode(F.array(F.concat(F.upper("table"), F.lit("--"), "column", F.lit("_val")), F.concat(F.lit("__"), "column", F.lit("__"), "table", F.lit("_Field")), F.col("column"))).alias("name")).distinct()
    return named.select("name", normalise_column(F.col("name")).alias("normalised"))


#: Columns of the given tables that a name or a stem decides; the others go by their type.
_DECIDED = [
    ("part", "p_brand", "stem", "commerce.product", "low"), ("lineitem", "l_discount", "stem", "commerce.quantity", "low"), ("lineitem", "l_tax", "stem", "finance.amount", "low"), ("documents", "text", "name", "text.long", "high"),
    ("pages", "url", "name", "contact.url", "high"), ("benchmark", "item_id", "stem", "commerce.quantity", "low"), ("benchmark", "text", "name", "text.long", "high"), ("conversations", "text", "name", "text.long", "high"),
]


@query(f"WITH {_COLUMNS}, x(t, c, s, g, f) AS (VALUES " + ", ".join(map(str, _DECIDED)) + ") SELECT c.t AS \"table\", c.c AS \"column\", coalesce(x.s, 'type') AS source, coalesce(x.g, '') AS generator, coalesce(x.f, 'low') AS confidence FROM c LEFT JOIN x ON x.t = c.t AND x.c = c.c")
def column_domain_map(spark, d):
    out = [(k, c.name, m.source, m.generator, m.confidence) for k, t in given_schema(spark, d).tables.items() for c in t.columns for m in [mapping.map_column(c, t)]]
    return spark.createDataFrame(out, "table string, column string, source string, generator string, confidence string")


_SCORES = [
    ("customerEmails", "person", 0.8), ("customerEmails", "contact", 0.8), ("patient_diagnosis", "person", 0.8), ("patient_diagnosis", "medical", 0.8), ("invoicePayments", "finance", 1.4), ("shipping_city", "commerce", 0.7),
    ("shipping_city", "location", 0.8), ("course_grades", "education", 1.4),
]


_HINTS = ", ".join(str((w, d, x)) for d, (x, ws) in vocabulary.STEMS.items() for w in ws)


@query("SELECT name, domain, score::DOUBLE AS score FROM (VALUES " + ", ".join(map(str, _SCORES)) + f""") t(name, domain, score) UNION ALL (WITH {_COLUMNS}, h(word, domain, weight) AS (VALUES {_HINTS}),
    w AS (SELECT name, unnest(string_split(name, '_')) AS word FROM (SELECT DISTINCT 'vehicle_' || c AS name FROM c)) SELECT name, domain, round(sum(weight), 6)::DOUBLE FROM w JOIN h ON w.word IN (h.word, h.word || 's') GROUP BY 1, 2)""")
def stem_scores(spark, d):
    """Scores of some names, and of the given tables' columns with one more word in front."""
    given = [f"vehicle_{r['column']}" for r in columns_frame(spark, given_schema(spark, d)).select("column").distinct().collect()]
    out = [(n, k, round(float(v), 6)) for n in ("customerEmails", "patient_diagnosis", "invoicePayments", "shipping_city", "course_grades", "key_id", *sorted(given)) for k, v in mapping.stem_scores(n).items()]
    return spark.createDataFrame(out, "name string, domain string, score double")




@query(f"""WITH {_COLUMNS}, h(word, domain, weight) AS (VALUES {_HINTS}), w AS (SELECT t, c, unnest(string_split(lower(c), '_')) AS word FROM c),
    s AS (SELECT t, c, domain, round(sum(weight), 6)::DOUBLE AS score FROM w JOIN h ON w.word IN (h.word, h.word || 's') GROUP BY 1, 2, 3)
    SELECT t AS "table", c AS "column", domain, score, row_number() OVER (PARTITION BY t, c ORDER BY score DESC, domain) AS rank FROM s""")
def column_stem_scores(spark, d):
    """Domains that the words of the given tables' column names hint at."""
    return mapping.score_columns(columns_frame(spark, given_schema(spark, d)).select("table", "column"))


_LISTED = "SELECT p_size, string_agg(DISTINCT {0}, {1} ORDER BY {0}) AS v FROM part GROUP BY p_size"


@query(f"""WITH e AS ({_LISTED.format("p_brand", "', '")}), x AS ({_LISTED.format("p_brand", "','")})
    SELECT e.p_size, k.k AS form, CASE k.k WHEN 'order' THEN '' ELSE x.v END AS vals FROM e JOIN x USING (p_size), (VALUES ('in'), ('any'), ('or'), ('order')) k(k)""")
def check_literals(spark, d):
    """Texts that CHECKs list, in the ways that catalogs write them: the brands of each size of parts."""
    brands = read(spark, d, "part").groupBy("p_size").agg(F.array_sort(F.collect_set("p_brand")).alias("v"))
    text = lambda f: F.transform("v", lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit(f)))
    forms = {
        "in": F.concat(F.lit("p_brand IN ("), F.array_join(text("'"), ", "), F.lit(")")), "any": F.concat(F.lit("(p_brand = ANY (ARRAY["), F.array_join(text("'::text"), ", "), F.lit("]))")),
        "or": F.concat(F.lit("(p_brand = "), F.array_join(text("'"), ") OR (p_brand = "), F.lit(")")), "order": F.concat(F.lit("p_brand > "), F.element_at(text("'"), 1)),
    }
    made = brands.select("p_size", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), e.alias("e")) for k, e in forms.items()])).alias("x")).select("p_size", "x.*")
    return made.select("p_size", "form", F.array_join(literals_column(F.col("e")), ",").alias("vals"))


@query(f"WITH {_COLUMNS} SELECT DISTINCT name FROM (SELECT t AS name FROM c UNION SELECT c FROM c) WHERE NOT regexp_full_match(name, '[^.]*s') AND NOT regexp_full_match(name, 'p[^.]*')")
def glob_exclude(spark, d):
    """Names of the given tables and their columns that no pattern matches."""
    c = columns_frame(spark, given_schema(spark, d))
    names_ = c.select(F.explode(F.array("table", "column")).alias("name")).distinct()
    for p in ("*s", "p*"):
        names_ = names_.where(~F.col("name").rlike(glob_regex(p)))
    assert not excluded("public.a", ["b*"])
    return names_


@query("""WITH b AS (SELECT DISTINCT c_mktsegment AS k FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders), a AS (SELECT substr(k, 2) AS w FROM b UNION SELECT k || 'x' FROM b),
    l AS (SELECT w, k, levenshtein(w, k) AS lev, row_number() OVER (PARTITION BY w ORDER BY levenshtein(w, k), k) AS rn FROM a, b) SELECT w, k AS suggestion, lev AS distance FROM l WHERE rn = 1 AND lev <= 2""")
def key_suggestion(spark, d):
    """Segments and priorities with a letter too few or too many."""
    known = sorted({*distinct(spark, d, "customer", "c_mktsegment"), *distinct(spark, d, "orders", "o_orderpriority")})
    words = {w for k in known for w in (k[1:], k + "x")}
    return spark.createDataFrame([(w, k, names.distance(w, k)) for w in sorted(words) if (k := names.suggest(w, known))], "w string, suggestion string, distance long")


# --- sinks


@query("""SELECT floor(ord / 10)::BIGINT AS batch, 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES ' || string_agg('(' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ')', ', ' ORDER BY ord) || ';' AS statement
    FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS ord FROM nation) GROUP BY 1""")
def insert_sql_text(spark, d):
    return sqltext.insert_statements(read(spark, d, "nation"), "nation", ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"], 10)


@query("""SELECT 'UPDATE "nation" SET "n_regionkey" = ' || n_regionkey || ' WHERE "n_nationkey" = ' || n_nationkey || ';' AS statement FROM nation""")
def update_sql_text(spark, d):
    return sqltext.update_statements(read(spark, d, "nation"), "nation", ["n_nationkey"], ["n_regionkey"])


@query("""SELECT o_orderkey || ',' || CASE WHEN o_orderkey % 7 = 0 THEN '\\N' ELSE CASE WHEN regexp_matches(o_orderpriority, '[",]') THEN '"' || replace(o_orderpriority, '"', '""') || '"' ELSE o_orderpriority END END || ',' || CASE WHEN o_custkey % 2 = 0 THEN 't' ELSE 'f' END AS line FROM orders""")
def copy_csv_lines(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("p"), (F.col("o_custkey") % 2 == 0).alias("even"))
    return df.select(sqltext.copy_lines(df, df.columns).alias("line"))


@query("SELECT floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 500)::BIGINT AS batch, o_orderkey FROM orders")
def insert_batches(spark, d):
    from ..operators.prefix import batch_number

    return ordinals(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "at").select(batch_number(F.col("at"), 500).alias("batch"), "o_orderkey")


@query("SELECT i AS n_columns, greatest(100, least(5000, floor(1000000.0 / (30 * i + 3 * i + 10))))::BIGINT AS batch FROM (SELECT DISTINCT p_size::BIGINT + 1 AS i FROM part) r")
def optimal_batch_size(spark, d):
    return read(spark, d, "part").select((F.col("p_size").cast("long") + 1).alias("n_columns")).distinct().select("n_columns", sqltext.optimal_batch(F.col("n_columns")).alias("batch"))


_WIDE = "repeat(md5(l_orderkey || '/' || l_linenumber || '/' || l_partkey), 5)"


@query(f"""WITH r AS (SELECT *, floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents, {_WIDE} AS pad FROM lineitem),
    o AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) - 1 AS ord FROM r)
    SELECT floor(ord / 500)::BIGINT AS batch, count(*) AS n_rows, md5('INSERT INTO "lines" ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "pad") VALUES ' || string_agg('(' || l_orderkey || ', ' || l_linenumber || ', ' || l_partkey || ', ' || l_suppkey || ', ' || cents || ', ''' || pad || ''')', ', ' ORDER BY ord) || ';') AS digest
    FROM o GROUP BY 1""")
def insert_rows_lineitem(spark, d):
    """All of lineitem as INSERT text, with 160 characters more a row: every row, in its statement, in its place."""
    pad = F.repeat(F.md5(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")), 5)
    wide = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rng.half_up(F.col("l_extendedprice") * 100).alias("cents"), pad.alias("pad"))
    made = sqltext.insert_statements(wide, "lines", wide.columns, wide.columns[:5], 500)
    return made.select("batch", (F.size(F.split("statement", r"\), \("))).cast("long").alias("n_rows"), F.md5("statement").alias("digest"))


@query("SELECT o_orderkey AS parent, (o_orderkey % 37)::BIGINT AS n FROM orders WHERE o_orderkey % 37 > 0 UNION ALL SELECT -1, sum(o_orderkey % 37)::BIGINT FROM orders UNION ALL SELECT -2, sum(o_orderkey % 37)::BIGINT - 1 FROM orders")
def expand_large(spark, d):
    """Each order with up to 36 children: distinct ordinals by parent, of all (parent -1), and the last one (-2)."""
    parents = read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("parent"), (F.col("o_orderkey") % 37).alias("n_children"))
    each = cardinality.expand(parents, SEED, "children", "parent", ["parent"])
    sums = each.agg(F.countDistinct("child_ord").alias("n"), F.max("child_ord").alias("last"))
    whole = sums.select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("parent"), F.col("n")), F.struct(F.lit(-2).cast("long").alias("parent"), F.col("last").alias("n")))).alias("x")).select("x.*")
    return each.groupBy("parent").agg(F.countDistinct("child_ord").alias("n")).unionAll(whole)


@query("SELECT o_orderkey, '(''' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || 'Z'')' AS v FROM orders")
def timestamp_literals(spark, d):
    """Moments as SQL text: in UTC, whatever the session's zone."""
    # The files' times have no zone; they stand for moments in UTC here.
    ntz = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    moments = ntz.select("o_orderkey", F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(F.col("at").cast("timestamp"), "UTC"))).alias("at"))
    return moments.select("o_orderkey", sqltext.row_values(moments, ["at"]).alias("v"))


# --- unique keys of several columns


@query("""WITH a AS (SELECT count(DISTINCT p_brand) AS brands FROM part), b AS (SELECT count(DISTINCT c_mktsegment) AS segments FROM customer), n AS (SELECT count(*) AS n FROM supplier)
    SELECT brands * segments AS n_rows, brands * segments AS n_keys, n AS n_free, n AS n_free_keys FROM a, b, n""")
def composite_unique_generated(spark, d):
    """All pairs of a brand and a segment, and as many pairs of a brand and a text as there are suppliers."""
    key = Column("id", Kind.BIGINT, nullable=False, auto_increment=True)
    brands, segments = distinct(spark, d, "part", "p_brand"), distinct(spark, d, "customer", "c_mktsegment")
    a, b = (Column(n, Kind.ENUM, nullable=False, values=v) for n, v in (("a", brands), ("b", segments)))
    s = Schema.of(Table("two", (key, a, b), ("id",), (), (("a", "b"),)), Table("free", (key, a, Column("first_name", Kind.VARCHAR, nullable=False, max_length=12)), ("id",), (), (("a", "first_name"),)))
    made = generate.generate(spark, s, generate.Config(SEED, rows_of={"two": len(brands) * len(segments), "free": n_rows(spark, d, "supplier")})).tables
    one = made["two"].agg(F.count("*").alias("n_rows"), F.countDistinct("a", "b").alias("n_keys"))
    return one.crossJoin(made["free"].agg(F.count("*").alias("n_free"), F.countDistinct("a", "first_name").alias("n_free_keys")))  # a row each


@query("""WITH b AS (SELECT count(DISTINCT p_brand) AS brands FROM part), s AS (SELECT count(DISTINCT c_mktsegment) AS segments FROM customer), p AS (SELECT count(DISTINCT o_orderpriority) AS priorities FROM orders),
    n AS (SELECT brands * least(segments, priorities) AS n FROM b, s, p) SELECT n AS n_rows, n AS n_left, n AS n_right FROM n""")
def shared_unique_keys(spark, d):
    """Unique (segment, brand) and unique (brand, priority) in one table, with as many rows as there can be."""
    key = Column("id", Kind.BIGINT, nullable=False, auto_increment=True)
    of = {"segment": distinct(spark, d, "customer", "c_mktsegment"), "brand": distinct(spark, d, "part", "p_brand"), "priority": distinct(spark, d, "orders", "o_orderpriority")}
    t = Table("t", (key, *(Column(n, Kind.ENUM, nullable=False, values=v) for n, v in of.items())), ("id",), (), (("segment", "brand"), ("brand", "priority")))
    n = len(of["brand"]) * min(len(of["segment"]), len(of["priority"]))
    made = generate.generate(spark, Schema.of(t), generate.Config(SEED, rows=n)).tables["t"]
    return made.agg(F.count("*").alias("n_rows"), F.countDistinct("segment", "brand").alias("n_left"), F.countDistinct("brand", "priority").alias("n_right"))


@query("""WITH r AS (SELECT l_orderkey AS o, l_linenumber::BIGINT AS x, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) - 1 AS k FROM lineitem),
    e AS (SELECT min(x) AS lo, max(x) AS hi FROM r), w AS (SELECT o, count(*) FILTER (k > 0) AS wanted, count(*) FILTER (k = 0) AS held FROM r GROUP BY o),
    z AS (SELECT CASE WHEN max(wanted + held) <= any_value(hi - lo + 1) THEN any_value(lo) ELSE least(0, any_value(lo)) END AS lo, CASE WHEN max(wanted + held) <= any_value(hi - lo + 1) THEN any_value(hi) ELSE 2147483647 END AS hi FROM w, e),
    t AS (SELECT o, x, x - lo - (row_number() OVER (PARTITION BY o ORDER BY x) - 1) AS before, row_number() OVER (PARTITION BY o ORDER BY x) AS shift FROM r, z WHERE k = 0),
    j AS (SELECT r.o, row_number() OVER (PARTITION BY r.o) - 1 AS n, wanted, hi - lo + 1 - held AS free, lo FROM r JOIN w ON w.o = r.o, z WHERE k > 0),
    p AS (SELECT o, lo, n, floor(n::HUGEINT * free / wanted)::BIGINT AS place FROM j),
    f AS (SELECT p.o, p.n, any_value(lo) + any_value(place) + coalesce(max(shift), 0) AS x FROM p LEFT JOIN t ON t.o = p.o AND t.before <= p.place GROUP BY p.o, p.n)
    SELECT o AS l_orderkey, x AS l_linenumber FROM r WHERE k = 0 UNION ALL SELECT o, x FROM f""")
def unique_free_values(spark, d):
    """Line numbers made unique within their orders: the first of equal ones stays, others get free numbers."""
    lines = ordinals(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "at")
    return unique.place_free(lines, "l_linenumber", "at", ("l_orderkey",)).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("""WITH p AS (SELECT count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part), s AS (SELECT min(p_size) AS small, max(p_size) AS large FROM part)
    SELECT n AS n_rows, 0::BIGINT AS outside, 0::BIGINT AS unordered, floor(low * 100)::BIGINT AS low_cents, ceil(high * 100)::BIGINT AS high_cents FROM p, s""")
def check_domains(spark, d):
    """As many rows as there are parts, under CHECKs made from the least and greatest price and size of all parts."""
    got = read(spark, d, "part").agg(F.count("*").alias("n"), F.floor(F.min("p_retailprice") * 100).alias("low"), F.ceil(F.max("p_retailprice") * 100).alias("high"), F.min("p_size").alias("small"), F.max("p_size").alias("large")).first()
    checks = (f"price >= {got['low'] / 100} AND price <= {got['high'] / 100}", f"size BETWEEN {got['small']} AND {got['large']}", "size < box AND box <= crate", f"crate <= {got['large'] * 3}")
    number = lambda n, kind=Kind.INTEGER, **more: Column(n, kind, nullable=False, **more)
    t = Table("t", (number("id", Kind.BIGINT, auto_increment=True), number("price", Kind.DECIMAL, precision=12, scale=2), number("size"), number("box"), number("crate")), ("id",), checks=tuple(Check(x) for x in checks))
    made = generate.generate(spark, Schema.of(t), generate.Config(SEED, rows=got["n"])).tables["t"]
    outside = ~F.col("price").between(F.lit(got["low"] / 100), F.lit(got["high"] / 100)) | ~F.col("size").between(got["small"], got["large"]) | (F.col("crate") > got["large"] * 3)
    counted = made.agg(F.count("*").alias("n_rows"), F.count_if(outside).alias("outside"), F.count_if((F.col("size") >= F.col("box")) | (F.col("box") > F.col("crate"))).alias("unordered"))
    return counted.select("*", F.lit(got["low"]).cast("long").alias("low_cents"), F.lit(got["high"]).cast("long").alias("high_cents"))


_STEPS = 2 * 365 * 86400 - 4
_D = f"list_sort([{', '.join(f'floor({U(SEED, chr(116), chr(95) * 2 + 'times', 'o_orderkey', k)} * {_STEPS})::BIGINT' for k in range(4))}])"
_V = lambda k, c: f"{REF - 2 * 365 * 86400} + d[{k + 1}] + {k} + floor({U(SEED, 't', c, 'o_orderkey')} * (" + (f"d[{k + 2}]" if k < 3 else str(_STEPS)) + f" - d[{k + 1}]))::BIGINT AS {c}"


@query(f"WITH r AS (SELECT o_orderkey, {_D} AS d FROM orders) SELECT o_orderkey, {_V(0, 'created_at')}, {_V(1, 'paid_at')}, {_V(2, 'shipped_at')}, {_V(3, 'delivered_at')} FROM r")
def temporal_chain(spark, d):
    """Created, paid, shipped, delivered: four times of every order, each after the one before (seconds)."""
    t = Table("t", tuple(Column(c, Kind.TIMESTAMPTZ) for c in ("delivered_at", "created_at", "shipped_at", "paid_at")))
    made = coherence.columns_of(coherence.detect(t)[0], Ctx(SEED, "t", "", F.col("o_orderkey"), REF))
    return read(spark, d, "orders").select("o_orderkey", *[F.unix_seconds(v).alias(c) for c, v in made.items()])


@query("SELECT 500::BIGINT AS n_rows, 500::BIGINT AS n_pairs, 0::BIGINT AS met, 0::BIGINT AS lost")
def bridge_augmented(spark, d):
    """500 more pairs of a customer and a part beside all that were ordered; none of them exists already."""
    have = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    key = lambda n: Column(n, Kind.BIGINT, nullable=False)
    pairs = Table("pairs", (key("o_custkey"), key("l_partkey")), ("o_custkey", "l_partkey"), (ForeignKey(("o_custkey",), "customer", ("c_custkey",)), ForeignKey(("l_partkey",), "part", ("p_partkey",))))
    s = Schema.of(Table("customer", (key("c_custkey"),), ("c_custkey",)), Table("part", (key("p_partkey"),), ("p_partkey",)), pairs)
    customer, part = read(spark, d, "customer"), read(spark, d, "part")
    made = generate.generate(spark, s, generate.Config(SEED, rows_of={"pairs": 500}), {"customer": customer, "part": part, "pairs": have}, ["pairs"]).tables["pairs"]
    marked = made.join(have.withColumn("old", F.lit(1)), ["o_custkey", "l_partkey"], "left")
    marked = marked.join(customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("c")), "o_custkey", "left").join(part.select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("p")), "l_partkey", "left")
    return marked.agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey", "l_partkey").alias("n_pairs"), F.count("old").alias("met"), F.count_if(F.col("c").isNull() | F.col("p").isNull()).alias("lost"))


@query(f"SELECT i + 1 AS id, floor({U(SEED, 'posts', 'user_id', 'i')} * (SELECT count(*) FROM customer))::BIGINT + 1 AS user_id FROM range((SELECT count(*) FROM orders)) r(i)")
def regenerated_child(spark, d):
    """A changed table alone: its references go to the parents that the same configuration makes, which aren't put out."""
    key = Column("id", Kind.BIGINT, nullable=False, auto_increment=True)
    s = Schema.of(Table("users", (key,), ("id",)), Table("posts", (key, Column("user_id", Kind.BIGINT, nullable=False)), ("id",), (ForeignKey(("user_id",), "users", ("id",)),)))
    before = diff.hashes(Schema.of(s.tables["users"]))
    made = generate.generate(spark, s, generate.Config(SEED, rows_of={"users": n_rows(spark, d, "customer"), "posts": n_rows(spark, d, "orders")}), None, diff.to_regenerate(before, s), unchanged=True)
    assert list(made.tables) == ["posts"]
    return made.tables["posts"]


# --- schema sources

_PARSED = {
    "prisma": """
        enum Level { LOW HIGH }
        model Shop { id Int @id @default(autoincrement())
          name String @unique @db.VarChar(40)
          level Level @default(LOW)
          stock Item[] }
        model Item { id String @id @default(uuid())
          price Decimal? @db.Decimal(8, 2)
          shopId Int @map("shop_id")
          shop Shop @relation(fields: [shopId], references: [id]) }""",
    "drizzle": """
        export const level = pgEnum('level', ['LOW', 'HIGH']);
        export const shop = pgTable('Shop', { id: serial('id').primaryKey(), name: varchar('name', { length: 40 }).notNull().unique(), level: level('level').notNull().default('LOW') });
        export const item = pgTable('Item', { id: uuid('id').primaryKey().defaultRandom(), price: numeric('price', { precision: 8, scale: 2 }), shopId: integer('shop_id').notNull().references(() => shop.id) });""",
    "typeorm": """
        export enum Level { LOW = 'LOW', HIGH = 'HIGH' }
        @Entity('Shop') export class Shop { @PrimaryGeneratedColumn() id: number; @Column({ type: 'varchar', length: 40, unique: true }) name: string; @Column({ type: 'enum', enum: Level }) level: Level; }
        @Entity('Item') export class Item { @PrimaryGeneratedColumn('uuid') id: string; @Column({ type: 'decimal', precision: 8, scale: 2, nullable: true }) price: number; @ManyToOne(() => Shop, { nullable: false }) @JoinColumn({ name: 'shop_id' }) shop: Shop; }""",
    "jpa": """
        public enum Level { LOW, HIGH }
        @Entity @Table(name = "Shop") public class Shop { @Id @GeneratedValue(strategy = GenerationType.IDENTITY) private Integer id; @Column(nullable = false, unique = true, length = 40) private String name; @Enumerated(EnumType.STRING) @Column(nullable = false) private Level level; }
        @Entity @Table(name = "Item") public class Item { @Id @GeneratedValue private UUID id; @Column(precision = 8, scale = 2) private BigDecimal price; @ManyToOne(optional = false) @JoinColumn(name = "shop_id") private Shop shop; }""",
}
_PARSED_ROWS = [
    ("Shop", "id", "integer", False, True, False, False), ("Shop", "name", "varchar", False, False, False, True), ("Shop", "level", "enum", False, False, False, False),
    ("Item", "id", "uuid", False, True, False, False), ("Item", "price", "decimal", True, False, False, False), ("Item", "shop_id", "integer", False, False, True, False),
]


@query("SELECT source, t.* FROM (VALUES ('prisma'), ('drizzle'), ('typeorm'), ('jpa')) s(source), (VALUES " + ", ".join(map(str, _PARSED_ROWS)) + f") t(\"table\", \"column\", kind, nullable, is_pk, is_fk, is_unique) UNION ALL (WITH {_COLUMNS} SELECT 'tables', t, c, CASE WHEN p % 2 = 0 THEN 'integer' ELSE 'text' END, p % 3 = 1, p = 0, false, p % 3 = 2 FROM c)")
def parsed_sources(spark, d):
    """The same two tables in four kinds of source text give the same columns; and the given tables, written as models
    whose fields have types and marks by their place, give back what was written."""
    from ..sources import drizzle, jpa, prisma, typeorm

    p = F.col("position")
    field = F.concat_ws(" ", F.lit(" "), "column", F.concat(F.when(p % 2 == 0, "Int").otherwise("String"), F.when(p % 3 == 1, "?").otherwise("")), F.when(p == 0, "@id").when(p % 3 == 2, "@unique"))
    fields = columns_frame(spark, given_schema(spark, d)).groupBy("table").agg(F.array_sort(F.collect_list(F.struct(p.alias("p"), field.alias("f")))).alias("fs"))
    models = fields.select(F.concat(F.lit("model "), "table", F.lit(" {\n"), F.array_join(F.transform("fs", lambda x: x["f"]), "\n"), F.lit("\n}")).alias("m")).collect()  # a text a table
    out = columns_frame(spark, prisma.parse("\n".join(sorted(r["m"] for r in models)))).select(F.lit("tables").alias("source"), "table", "column", "kind", "nullable", "is_pk", "is_fk", "is_unique")
    for name, parse in (("prisma", prisma.parse), ("drizzle", drizzle.parse), ("typeorm", typeorm.parse), ("jpa", jpa.parse)):
        one = columns_frame(spark, parse(_PARSED[name])).select(F.lit(name).alias("source"), "table", "column", "kind", "nullable", "is_pk", "is_fk", "is_unique")
        out = one if out is None else out.unionAll(one)
    return out


#: Rows as the catalog of a database gives them.
CATALOG_COLUMNS = [
    ("authors", "id", 1, "integer", False, "nextval('authors_id_seq'::regclass)", "", False, None, None), ("authors", "email", 2, "character varying(80)", False, None, "", False, None, None),
    ("authors", "mood", 3, "mood", True, None, "", False, "mood", "how they feel"), ("books", "id", 1, "bigint", False, None, "a", False, None, None), ("books", "author_id", 2, "integer", False, None, "", False, None, None),
    ("books", "state", 3, "text", False, "'draft'::text", "", False, None, None), ("books", "price", 4, "numeric(8,2)", True, None, "", False, None, None), ("books", "net", 5, "numeric(8,2)", True, None, "", True, None, None),
    ("reviews", "book_id", 1, "bigint", False, None, "", False, None, None), ("reviews", "reviewer", 2, "character varying(40)", False, None, "", False, None, None), ("reviews", "tags", 3, "text[]", True, None, "", False, None, None),
]
CATALOG_ENUMS = [("mood", "sad", 2.0), ("mood", "ok", 3.0), ("mood", "glad", 1.0)]
CATALOG_CONSTRAINTS = [
    ("authors", "authors_pkey", "p", "id", 1, None, None, None, None, False, None), ("authors", "authors_email_key", "u", "email", 1, None, None, None, None, False, None), ("books", "books_pkey", "p", "id", 1, None, None, None, None, False, None),
    ("books", "books_author_fkey", "f", "author_id", 1, "authors", "id", "c", "a", True, None), ("books", "books_state_check", "c", "state", 1, None, None, None, None, False, "(state = ANY (ARRAY['draft'::text, 'live'::text]))"),
    ("books", "books_price_check", "c", "price", 1, None, None, None, None, False, "(price >= (0)::numeric)"), ("books", "books_title_idx", "i", "state", 2, None, None, None, None, False, None), ("books", "books_title_idx", "i", "author_id", 1, None, None, None, None, False, None),
    ("reviews", "reviews_pkey", "p", "reviewer", 2, None, None, None, None, False, None), ("reviews", "reviews_pkey", "p", "book_id", 1, None, None, None, None, False, None), ("reviews", "reviews_book_fkey", "f", "book_id", 1, "books", "id", "n", "r", False, None),
]
COLUMN_SHAPE = "table_name string, column_name string, position int, data_type string, nullable boolean, column_default string, identity string, generated boolean, enum_name string, comment string"
CONSTRAINT_SHAPE = "table_name string, constraint_name string, kind string, column_name string, position int, ref_table string, ref_column string, on_delete string, on_update string, deferrable boolean, expression string"


def catalog_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame(CATALOG_COLUMNS, COLUMN_SHAPE), spark.createDataFrame(CATALOG_CONSTRAINTS, CONSTRAINT_SHAPE), spark.createDataFrame(CATALOG_ENUMS, "enum_name string, label string, position double")


def _values(rows: list[tuple], shape: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ") x(" + ", ".join(f.split()[0] for f in shape.split(", ")) + ")"


_ACT = "CASE max({0}) WHEN 'a' THEN 'NO ACTION' WHEN 'r' THEN 'RESTRICT' WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' ELSE 'NO ACTION' END"


@query(f"""SELECT table_name, constraint_name, kind, string_agg(column_name, ',' ORDER BY position) AS columns, coalesce(max(ref_table), '') AS ref_table, coalesce(string_agg(ref_column, ',' ORDER BY position), '') AS refs,
    {_ACT.format('on_delete')} AS on_delete, {_ACT.format('on_update')} AS on_update, bool_or(can_defer) AS can_defer FROM {_values(CATALOG_CONSTRAINTS, CONSTRAINT_SHAPE.replace('deferrable', 'can_defer'))} WHERE kind <> 'c' GROUP BY 1, 2, 3
    UNION ALL (WITH {_COLUMNS} SELECT t, t || '_all', 'u', string_agg(c, ',' ORDER BY p DESC), '', '', 'NO ACTION', 'NO ACTION', false FROM c GROUP BY t)""")
def catalog_keys(spark, d):
    """Keys of catalog rows: columns in order, references with their actions; and a key over all columns of each given
    table, numbered from behind."""
    own = columns_frame(spark, given_schema(spark, d))
    null = F.lit(None).cast("string")
    every = own.select(
        F.col("table").alias("table_name"), F.concat("table", F.lit("_all")).alias("constraint_name"), F.lit("u").alias("kind"), F.col("column").alias("column_name"), (-F.col("position")).cast("int").alias("position"),
        *[null.alias(c) for c in ("ref_table", "ref_column", "on_delete", "on_update")], F.lit(False).alias("deferrable"), null.alias("expression"),
    )
    found = introspect.key_lists(catalog_frames(spark)[1].unionByName(every))
    return found.select("table_name", "constraint_name", "kind", F.array_join("columns", ",").alias("columns"), F.coalesce("ref_table", F.lit("")).alias("ref_table"), F.array_join("references", ",").alias("refs"), "on_delete", "on_update", F.col("deferrable").alias("can_defer"))


@query(f"""SELECT enum_name, string_agg(label, ',' ORDER BY position) AS labels FROM {_values(CATALOG_ENUMS, 'enum_name string, label string, position double')} GROUP BY 1
    UNION ALL SELECT 'size_' || p_size, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand DESC) FROM part GROUP BY p_size""")
def catalog_enums(spark, d):
    """Labels of enumerations in their order; among them the brands of each size of parts, from the last to the first."""
    brands = read(spark, d, "part").select(F.concat(F.lit("size_"), "p_size").alias("enum_name"), F.col("p_brand").alias("label")).distinct()
    placed = brands.withColumn("position", F.rank().over(Window.partitionBy("enum_name").orderBy(F.desc("label"))).cast("double"))
    return introspect.enum_lists(catalog_frames(spark)[2].unionByName(placed)).select("enum_name", F.array_join("labels", ",").alias("labels"))


_INTROSPECTED = [
    ("authors", "id", "integer", False, True, False, False, True, False, ""), ("authors", "email", "varchar", False, False, False, True, False, False, ""), ("authors", "mood", "enum", True, False, False, False, False, False, "glad,sad,ok"),
    ("books", "id", "bigint", False, True, False, False, True, False, ""), ("books", "author_id", "integer", False, False, True, False, False, False, ""), ("books", "state", "text", False, False, False, False, False, False, "draft,live"),
    ("books", "price", "decimal", True, False, False, False, False, False, ""), ("books", "net", "decimal", True, False, False, False, False, True, ""), ("reviews", "book_id", "bigint", False, True, True, False, False, False, ""),
    ("reviews", "reviewer", "varchar", False, True, False, False, False, False, ""), ("reviews", "tags", "array", True, False, False, False, False, False, ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(map(str, _INTROSPECTED)) + f") t(\"table\", \"column\", kind, nullable, is_pk, is_fk, is_unique, is_auto, is_generated, \"values\") UNION ALL (WITH {_COLUMNS} SELECT t, c, 'varchar', p > 0, p = 0, false, false, false, false, '' FROM c)")
def catalog_schema(spark, d):
    """A schema from catalog rows: kinds, keys, identity, generated columns, enumerations and listed checks; and the given
    tables, as a catalog would list them, with their first column as key."""
    columns, constraints, enums = catalog_frames(spark)
    own, null = columns_frame(spark, given_schema(spark, d)), F.lit(None).cast("string")
    columns = columns.unionByName(own.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), (F.col("position") + 1).cast("int").alias("position"), F.lit("character varying(20)").alias("data_type"), (F.col("position") > 0).alias("nullable"), null.alias("column_default"), F.lit("").alias("identity"), F.lit(False).alias("generated"), null.alias("enum_name"), null.alias("comment")))
    first = own.where("position = 0").select(F.col("table").alias("table_name"), F.concat("table", F.lit("_pkey")).alias("constraint_name"), F.lit("p").alias("kind"), F.col("column").alias("column_name"), F.lit(1).alias("position"), *[null.alias(c) for c in ("ref_table", "ref_column", "on_delete", "on_update")], F.lit(False).alias("deferrable"), null.alias("expression"))
    constraints = constraints.unionByName(first)
    s = introspect.schema_of_catalog(columns, constraints, enums)
    listed = spark.createDataFrame([(k, c.name, ",".join(c.values)) for k, t in s.tables.items() for c in t.columns], "table string, column string, values string")
    return columns_frame(spark, s).drop("position").join(listed, ["table", "column"])


# --- changes and reports


_PICKED = ["customer", "lineitem", "nation", "orders", "region", "supplier"]


@query(f"SELECT name, name = 'lineitem' AS selected, name <> 'lineitem' AS auto_included FROM (VALUES {', '.join(f'({t!r})' for t in _PICKED)}) t(name)")
def filtered_schema(spark, d):
    """lineitem with the tables that it needs, but without any that match p*."""
    r = filter_schema(given_schema(spark, d), ["lineitem"], ["p*"])
    return spark.createDataFrame([(k, k in r.selected, k in r.auto_included) for k in r.schema.tables], "name string, selected boolean, auto_included boolean")


@query(f"""WITH {_COLUMNS} SELECT t AS "table", sha256(string_agg(c || ':' || p, ';' ORDER BY c || ':' || p)) AS hash FROM c GROUP BY t""")
def schema_hash_tables(spark, d):
    """Hashes of the given tables' columns and their places."""
    cols = columns_frame(spark, given_schema(spark, d)).select("table", "column", F.col("position").cast("string").alias("kind"))
    return diff.hash_columns(cols)


@query(f"""WITH {_COLUMNS} SELECT split_part(c, '_', 1) AS "table", sha256(string_agg(c || ':' || t, ';' ORDER BY c || ':' || t)) AS hash FROM c GROUP BY 1""")
def schema_hash(spark, d):
    """Hashes of the given tables' columns, by the first word of their names."""
    cols = columns_frame(spark, given_schema(spark, d)).select(F.split_part("column", F.lit("_"), F.lit(1)).alias("first"), "column", F.col("table").alias("kind"))
    return diff.hash_columns(cols, "first").withColumnRenamed("first", "table")


@query(f"""WITH {_COLUMNS}, n AS (SELECT CASE t WHEN 'events' THEN 'happenings' ELSE t END AS t, c, CASE WHEN t LIKE 'p%' THEN p + 1 ELSE p END AS p FROM c),
    a AS (SELECT t, sha256(string_agg(c || ':' || p, ';' ORDER BY c || ':' || p)) AS h FROM c GROUP BY t), b AS (SELECT t, sha256(string_agg(c || ':' || p, ';' ORDER BY c || ':' || p)) AS h FROM n GROUP BY t)
    SELECT COALESCE(a.t, b.t) AS "table", CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.t = b.t""")
def schema_diff(spark, d):
    """The given tables against the same ones with one renamed, and others' columns moved by a place."""
    cols = columns_frame(spark, given_schema(spark, d)).select("table", "column", F.col("position").alias("kind"))
    moved = cols.select(F.when(F.col("table") == "events", "happenings").otherwise(F.col("table")).alias("table"), "column", (F.col("kind") + F.col("table").startswith("p").cast("int")).alias("kind"))
    hashed = [diff.hash_columns(x.withColumn("kind", F.col("kind").cast("string"))) for x in (cols, moved)]
    return diff.compare(*hashed)


@query(f'WITH {_COLUMNS} SELECT t AS "table", c AS "column", p AS position FROM c')
def inspect_columns(spark, d):
    return columns_frame(spark, given_schema(spark, d)).select("table", "column", "position")


_ORDER = ["benchmark", "conversations", "documents", "embeddings", "labels", "pages", "part", "region", "nation", "customer", "events", "orders", "supplier", "lineitem"]


@query(f"""WITH {_COLUMNS}, {_E}, k(t, pk) AS (VALUES {", ".join(f"('{t}', '{c}')" for t, c in PRIMARY.items())}), o(t, i) AS (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(_ORDER))})
    SELECT o.t AS "table", (SELECT count(*) FROM c WHERE c.t = o.t)::INT AS n_columns, coalesce((SELECT pk FROM k WHERE k.t = o.t), '') AS primary_key, o.i AS insert_order,
           (SELECT count(*) FROM e WHERE child = o.t) AS "references", (SELECT count(*) FROM e WHERE parent = o.t) AS referenced_by FROM o""")
def inspect_summary(spark, d):
    from ..schema import inspect

    return inspect(spark, given_schema(spark, d))


@query("WITH p AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS ord FROM benchmark), n AS (SELECT count(*) AS n FROM p) SELECT o.o_orderkey, p.text AS note FROM orders o, n JOIN p ON p.ord = o.o_orderkey % n.n")
def text_pool_fill(spark, d):
    return generate.text_pool_fill(read(spark, d, "orders").select("o_orderkey"), "note", read(spark, d, "benchmark").select("text"), "o_orderkey")


@query()
def generated_shop(spark, d):
    """Row counts and reference checks of a generated schema with a tree, a bridge and a cardinality."""
    key = lambda n="id": Column(n, Kind.BIGINT, nullable=False, auto_increment=True)
    s = Schema.of(
        Table("users", (key(), Column("first_name", Kind.VARCHAR, max_length=40, nullable=False), Column("email", Kind.VARCHAR, max_length=60, nullable=False), Column("created_at", Kind.TIMESTAMPTZ, nullable=False), Column("updated_at", Kind.TIMESTAMPTZ, nullable=False)), ("id",), (), (("email",),)),
        Table("posts", (key(), Column("user_id", Kind.BIGINT, nullable=False), Column("title", Kind.VARCHAR, max_length=50), Column("status", Kind.ENUM, nullable=False, values=("draft", "live"))), ("id",), (ForeignKey(("user_id",), "users", ("id",)),)),
        Table("tags", (key(), Column("name", Kind.VARCHAR, max_length=30, nullable=False), Column("parent_id", Kind.BIGINT)), ("id",), (ForeignKey(("parent_id",), "tags", ("id",)),), (("name",),)),
        Table("post_tags", (Column("post_id", Kind.BIGINT, nullable=False), Column("tag_id", Kind.BIGINT, nullable=False)), ("post_id", "tag_id"), (ForeignKey(("post_id",), "posts", ("id",)), ForeignKey(("tag_id",), "tags", ("id",)))),
    )
    config = generate.Config(SEED, rows_of={"users": n_rows(spark, d, "customer"), "posts": n_rows(spark, d, "orders"), "tags": n_rows(spark, d, "supplier"), "post_tags": n_rows(spark, d, "orders") * 2}, cardinality={"posts": {"user_id": cardinality.Cardinality(0, 20, "zipf")}})
    made = generate.generate(spark, s, config).tables
    out = None
    for t, by in (("users", "email"), ("posts", "id"), ("tags", "name"), ("post_tags", "post_id,tag_id")):
        one = made[t].agg(F.lit(t).alias("table"), F.count("*").alias("n_rows"), F.countDistinct(*by.split(",")).alias("n_distinct"))
        out = one if out is None else out.unionAll(one)
    return out


S["generated_shop"] = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {k} * count(*) AS n_rows, {k} * count(*) AS n_distinct FROM {of}" for t, k, of in (("users", 1, "customer"), ("posts", 1, "orders"), ("tags", 1, "supplier"), ("post_tags", 2, "orders")))


@query("SELECT i + 1 AS id, {} < 0.5 AS is_live FROM range((SELECT count(*) FROM orders)) r(i)".format(U(SEED, "flags", "is_live", "i")))
def streamed_rows(spark, d):
    """Rows that a stream generated, run until its source is used up: equal to the batch, whatever the trigger."""
    t = Table("flags", (Column("id", Kind.BIGINT, nullable=False, auto_increment=True), Column("is_live", Kind.BOOLEAN, nullable=False)), ("id",))
    return streamed(spark, t, generate.Config(SEED), n_rows(spark, d, "orders"))


#: Row numbers in a file of a stream's source.
STREAMED = 500_000


def streamed(spark: SparkSession, t: Table, config: generate.Config, n: int, schema: Schema | None = None, existing_rows=None) -> DataFrame:
    """n rows of a table through a stream: row numbers come from files of bounded size, in two triggers, and rows go to files."""
    from ..streaming.generator import project, write_stream

    parts = max(4, -(-n // STREAMED))
    numbers = materialise(spark.range(0, n, 1, parts).select(F.col("id").alias("__row")), "numbers")
    source = spark.readStream.schema("__row long").option("maxFilesPerTrigger", -(-parts // 2)).parquet(numbers.scratch_path)
    made = project(source, t, config, schema, existing_rows)
    at = numbers.scratch_path + "-streamed"
    write_stream(made, at, at + "-checkpoint")
    return spark.read.schema(made.schema).parquet(at)


_ORD = U(SEED, "returns", "o_orderkey", "i")


@query(f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders)
    SELECT i + 1 AS id, o.o_orderkey, CASE WHEN {U(SEED, 'returns', 'note?', 'i')} >= 0.1 THEN (['new','paid','sent','done'])[(floor({U(SEED, 'returns', 'note', 'i')} * 4) + 1)::INT] END AS note
    FROM range(300) r(i) JOIN o ON o.ord = floor({_ORD} * (SELECT count(*) FROM orders))::BIGINT""")
def streamed_references(spark, d):
    """A stream with references to existing rows, and NULLs: a join of the stream with the parents' keys."""
    t = Table("returns", (Column("id", Kind.BIGINT, nullable=False, auto_increment=True), Column("o_orderkey", Kind.BIGINT, nullable=False), Column("note", Kind.TEXT, values=tuple(SEGMENTS))), ("id",), (ForeignKey(("o_orderkey",), "orders", ("o_orderkey",)),))
    parent = Table("orders", (Column("o_orderkey", Kind.BIGINT, nullable=False),), ("o_orderkey",))
    return streamed(spark, t, generate.Config(SEED), 300, Schema.of(parent, t), {"orders": read(spark, d, "orders")})


@query("SELECT count(*) AS n_rows, count(*) AS n_names, count(*) AS n_pairs, 0::BIGINT AS out_of_range FROM orders")
def streamed_unique(spark, d):
    """A stream with a unique text and a unique pair of references."""
    left, right, n = n_rows(spark, d, "customer"), n_rows(spark, d, "part"), n_rows(spark, d, "orders")
    key = Column("id", Kind.BIGINT, nullable=False, auto_increment=True)
    links = Table("links", (Column("a_id", Kind.BIGINT, nullable=False), Column("b_id", Kind.BIGINT, nullable=False), Column("name", Kind.VARCHAR, max_length=20, nullable=False)), ("a_id", "b_id"), (ForeignKey(("a_id",), "a", ("id",)), ForeignKey(("b_id",), "b", ("id",))), (("name",),))
    s = Schema.of(Table("a", (key,), ("id",)), Table("b", (key,), ("id",)), links)
    made = streamed(spark, links, generate.Config(SEED, rows_of={"a": left, "b": right, "links": n}), n, s)
    sums = made.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("a_id").between(1, left) | ~F.col("b_id").between(1, right)).alias("out_of_range"))
    # Each distinct count by itself: together they would make two rows of each, and a task would hold both.
    names = made.agg(F.countDistinct("name").alias("n_names"))
    pairs = made.agg(F.countDistinct("a_id", "b_id").alias("n_pairs"))
    return sums.crossJoin(names).crossJoin(pairs).select("n_rows", "n_names", "n_pairs", "out_of_range")  # a row each


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)
