"""Unique keys of several columns, existing rows, regeneration, sinks of databases, sources of catalogs, streams."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from rowloom import api, cli
from rowloom.errors import ConnectionFailed, GenerationFailed, IntrospectionFailed, MissingTarget, OutputFailed
from rowloom.operators import generate
from rowloom.plans import registry
from rowloom.schema import Column, ForeignKey, Kind, Schema, Table
from rowloom.sinks import sqltext
from rowloom.sources import introspect
from rowloom.streaming.generator import project

KEY = Column("id", Kind.INTEGER, nullable=False, auto_increment=True)
BOTH = Schema.of(
    Table("p", (KEY,), ("id",)), Table("q", (KEY,), ("id",)),
    Table("pq", (Column("p_id", Kind.INTEGER, nullable=False), Column("q_id", Kind.INTEGER, nullable=False)), ("p_id", "q_id"), (ForeignKey(("p_id",), "p", ("id",)), ForeignKey(("q_id",), "q", ("id",)))),
)
DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_keys_of_known_domains(spark):
    pick = lambda name, n: Column(name, Kind.ENUM, nullable=False, values=tuple(f"{name}{i}" for i in range(n)))
    t = Table("t", (KEY, pick("a", 10), pick("b", 10), Column("on", Kind.BOOLEAN, nullable=False)), ("id",), (), (("a", "b"),))
    got = generate.generate(spark, Schema.of(t), generate.Config(rows=80)).tables["t"]
    assert got.select("a", "b").distinct().count() == 80
    with pytest.raises(GenerationFailed):
        generate.generate(spark, Schema.of(t), generate.Config(rows=101))
    three = Table("t", (KEY, pick("a", 3), pick("b", 4), Column("on", Kind.BOOLEAN, nullable=False)), ("id",), (), (("a", "b", "on"),))
    assert generate.generate(spark, Schema.of(three), generate.Config(rows=24)).tables["t"].select("a", "b", "on").distinct().count() == 24
    alone = Table("t", (KEY, pick("a", 5)), ("id",), (), (("a",),))
    assert generate.generate(spark, Schema.of(alone), generate.Config(rows=5)).tables["t"].select("a").distinct().count() == 5


@pytest.mark.parametrize("free", [Column("x", Kind.VARCHAR, max_length=12, nullable=False), Column("x", Kind.SMALLINT, nullable=False), Column("x", Kind.DATE, nullable=False), Column("x", Kind.TIMESTAMP, nullable=False), Column("x", Kind.TEXT)])
def test_keys_with_a_free_column(spark, free):
    t = Table("t", (KEY, Column("a", Kind.ENUM, nullable=False, values=("u", "v")), free), ("id",), (), (("a", "x"),))
    over = {"t": {"x": {"builder": lambda c: F.element_at(F.array(*[F.lit(v) for v in {"text": ["k", "l"], "varchar": ["k", "l"], "smallint": [1, 2]}.get(str(free.kind), ["2024-01-01", "2024-02-28"])]), (c.row % 2 + 1).cast("int"))}}}
    first = generate.generate(spark, Schema.of(t), generate.Config(rows=40, overrides=over)).tables["t"]
    n = first.where("x is not null").count()
    assert first.where("x is not null").select("a", "x").distinct().count() == n
    first = first.cache()
    more = generate.generate(spark, Schema.of(t), generate.Config(seed=9, rows=40, overrides=over), {"t": first}).tables["t"]
    both = more.unionAll(first).where("x is not null")
    assert both.select("a", "x").distinct().count() == both.count()


def test_existing_pairs_and_references_are_left_out(spark):
    old = {k: v.cache() for k, v in generate.generate(spark, BOTH, generate.Config(rows=10, rows_of={"pq": 50})).tables.items()}
    new = generate.generate(spark, BOTH, generate.Config(rows_of={"pq": 50}), old, ["pq"]).tables["pq"]
    assert new.count() == 50 and new.unionAll(old["pq"]).distinct().count() == 100
    with pytest.raises(GenerationFailed):
        generate.generate(spark, BOTH, generate.Config(rows_of={"pq": 51}), old, ["pq"])
    s = Schema.of(BOTH.tables["p"], Table("one", (KEY, Column("p_id", Kind.INTEGER, nullable=False)), ("id",), (ForeignKey(("p_id",), "p", ("id",)),), (("p_id",),)))
    have = spark.createDataFrame([(1, 3), (2, 7)], "id int, p_id int")
    got = generate.generate(spark, s, generate.Config(rows_of={"one": 8}), {"p": old["p"], "one": have}, ["one"]).tables["one"]
    assert sorted(r["p_id"] for r in got.collect()) == [1, 2, 4, 5, 6, 8, 9, 10] and {r["id"] for r in got.collect()} == set(range(3, 11))


def test_regeneration_with_unchanged_parents(spark, tmp_path):
    whole = generate.generate(spark, BOTH, generate.Config(rows=12)).tables
    alone = generate.generate(spark, BOTH, generate.Config(rows=12), only=["pq"], unchanged=True)
    assert list(alone.tables) == ["pq"] and alone.counts == {"pq": 12}
    assert sorted(alone.tables["pq"].collect()) == sorted(whole["pq"].collect())
    assert generate.generate(spark, BOTH, generate.Config(rows=12), only=[]).tables == {}


def test_deferred_references_in_sql(spark, tmp_path):
    api.run_pipeline(spark, registry._cycle(), generate.Config(rows=6), path=str(tmp_path / "x"), form="sql")
    folders = sorted(f.name for f in (tmp_path / "x").iterdir())
    assert folders == ["0000_orders", "0001_invoices", "0002_orders_updates"]
    text = lambda n: [x for f in sorted((tmp_path / "x" / n).glob("*.txt")) for x in f.read_text().splitlines()]
    assert all("NULL" in x for x in text("0000_orders") if x.startswith("INSERT"))
    updates = text("0002_orders_updates")
    assert len(updates) == 6 and all(x.startswith('UPDATE "orders" SET "invoice_id" = ') for x in updates)


def test_moments_do_not_depend_on_the_session(spark):
    df = spark.sql("select timestamp_micros(1717243200500000) a, timestamp_ntz'2024-03-10 02:30:00' b, timestamp_micros(-315619199999000) c")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(sqltext.row_values(df, df.columns).alias("x")).first()["x"] == "('2024-06-01T12:00:00.500Z', '2024-03-10T02:30:00.000', '1960-01-01T00:00:00.001Z')"
            assert df.select(sqltext.copy_lines(df, ["a", "b"]).alias("x")).first()["x"] == "2024-06-01T12:00:00.500Z,2024-03-10T02:30:00.000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_database_by_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sqltext.run_jdbc(spark, url, ['CREATE TABLE parents ("id" INTEGER PRIMARY KEY)', 'CREATE TABLE children ("id" INTEGER PRIMARY KEY, "p_id" INTEGER NOT NULL REFERENCES parents)'], **DERBY)
    s = Schema.of(Table("parents", (KEY,), ("id",)), Table("children", (KEY, Column("p_id", Kind.INTEGER, nullable=False)), ("id",), (ForeignKey(("p_id",), "parents", ("id",)),)))
    read = lambda t: spark.read.format("jdbc").options(url=url, dbtable=t, **DERBY).load()
    run = lambda mode, existing=None: api.run_pipeline(spark, s, generate.Config(rows=20), existing, url=url, mode=mode, jdbc=DERBY)
    run("append", "target")
    assert read("children").count() == 20
    run("append", "target")
    assert sorted(r["id"] for r in read("children").collect()) == list(range(1, 41))
    with pytest.raises(OutputFailed):
        run("errorifexists")
    run("overwrite")
    assert read("children").count() == 20 and read("parents").count() == 20
    with pytest.raises(OutputFailed):
        run("append")  # keys repeat
    with api.with_seed(spark, s, url=url, jdbc=DERBY) as seeder:
        seeder.begin()
        seeder.seed("parents", 3)
        assert read("parents").count() == 20
        seeder.rollback()
        seeder.begin()
        seeder.seed("parents", 3)
        seeder.seed("children", 4)
        seeder.commit()
        assert read("parents").count() == 23 and read("children").count() == 24
    assert read("parents").count() == 20 and read("children").count() == 20
    with pytest.raises(ConnectionFailed):
        sqltext.write_jdbc(api.seed(spark, s, count=1).tables, ["parents"], "jdbc:postgresql://db.prod.example.com/x")
    with pytest.raises(MissingTarget):
        sqltext.write_jdbc({}, [], "")


def test_a_seeder_that_writes_folders_and_sqlite(spark, tmp_path):
    with api.with_seed(spark, BOTH, path=str(tmp_path / "out")) as s:
        s.table("p", 5).table("q", 5).table("pq", 9).execute()
        assert spark.read.parquet(str(tmp_path / "out" / "pq")).count() == 9
    assert not (tmp_path / "out" / "pq").exists()
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.executescript("CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE q(id INTEGER PRIMARY KEY); CREATE TABLE pq(p_id INTEGER, q_id INTEGER, PRIMARY KEY (p_id, q_id)); INSERT INTO p VALUES (7)")
    with api.with_seed(spark, BOTH, url=f"sqlite:{tmp_path / 'x.db'}") as s:
        assert sorted(r["id"] for r in s.seed("p", 2).collect()) == [8, 9]
        with sqlite3.connect(tmp_path / "x.db") as db:
            assert db.execute("SELECT count(*) FROM p").fetchone()[0] == 3
    with sqlite3.connect(tmp_path / "x.db") as db:
        assert db.execute("SELECT id FROM p").fetchall() == [(7,)]


def test_catalog_rows_become_a_schema(spark):
    columns, constraints, enums = registry.catalog_frames(spark)
    s = introspect.schema_of_catalog(columns, constraints, enums)
    books, reviews = s.tables["books"], s.tables["reviews"]
    assert reviews.primary_key == ("book_id", "reviewer") and s.tables["authors"].uniques == (("email",),) and s.enums == {"mood": ("glad", "sad", "ok")}
    fk = books.foreign_keys[0]
    assert (fk.table, fk.references, fk.on_delete, fk.on_update, fk.deferrable) == ("authors", ("id",), "CASCADE", "NO ACTION", True)
    assert books.column("state").values == ("draft", "live") and books.column("price").values == () and books.indexes[0].columns == ("author_id", "state") and books.indexes[0].unique
    assert books.column("price").precision == 8 and s.tables["authors"].column("email").max_length == 80 and books.column("net").generated
    made = api.seed(spark, s, count=12).tables
    assert made["books"].select("author_id", "state").distinct().count() == 12 and "net" not in made["books"].columns
    empty = introspect.schema_of_catalog(columns.limit(0), constraints.limit(0), enums.limit(0))
    assert empty.tables == {}
    for dialect in introspect.QUERIES:
        assert all("'shop'" in q and "{" not in q for q in introspect.catalog_sql(dialect, "shop").values())
    with pytest.raises(IntrospectionFailed):
        introspect.catalog_sql("postgres", "x'; DROP")
    with pytest.raises(ConnectionFailed):
        introspect.introspect(spark, "postgresql://db.prod.example.com/x")


def test_mysql_catalog_rows(spark):
    columns = spark.createDataFrame([("t", "id", 1, "int unsigned", False, None, "d", False, None, ""), ("t", "k", 2, "enum('a','b''c')", True, None, "", False, None, "note"), ("t", "f", 3, "tinyint(1)", False, "0", "", False, None, "")], registry.COLUMN_SHAPE)
    constraints = spark.createDataFrame([("t", "PRIMARY", "p", "id", 1, None, None, None, None, False, None)], registry.CONSTRAINT_SHAPE)
    t = introspect.schema_of_catalog(columns, constraints, None, "mysql").tables["t"]
    assert [c.kind for c in t.columns] == [Kind.INTEGER, Kind.ENUM, Kind.BOOLEAN] and t.column("k").values == ("a", "b'c") and t.column("id").auto_increment and t.column("k").comment == "note"


def test_command_line_reads_and_augments_a_database(spark, tmp_path, capsys):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.executescript("CREATE TABLE p(id INTEGER PRIMARY KEY, name TEXT NOT NULL); CREATE TABLE c(id INTEGER PRIMARY KEY, p_id INTEGER NOT NULL REFERENCES p); INSERT INTO p VALUES (41, 'a')")
    conf = tmp_path / "rowloom.yml"
    conf.write_text(f"connection:\n  url: sqlite:{tmp_path / 'x.db'}\ncount: 5\n")
    assert cli.main(["--config", str(conf), "--json", "--progress"]) == 0
    out = capsys.readouterr()
    assert '"total": 10' in out.out and "written p: 5 rows" in out.err
    with sqlite3.connect(tmp_path / "x.db") as db:
        assert sorted(i for (i,) in db.execute("SELECT id FROM p")) == [41, 42, 43, 44, 45, 46]
        assert db.execute("SELECT count(*) FROM c WHERE p_id NOT IN (SELECT id FROM p)").fetchone()[0] == 0


def test_streams_equal_batches(spark):
    numbers = spark.range(30).select(F.col("id").alias("__row"))
    config = generate.Config(rows=30, rows_of={"p": 8, "q": 9})
    batch = generate.generate(spark, BOTH, config).tables["pq"]
    assert sorted(project(numbers, BOTH.tables["pq"], config, BOTH).collect()) == sorted(batch.collect())
    tree = Schema.of(Table("t", (KEY, Column("up", Kind.INTEGER), Column("note", Kind.TEXT)), ("id",), (ForeignKey(("up",), "t", ("id",)),)))
    config = generate.Config(rows=30, null_rate=0.4)
    batch = generate.generate(spark, tree, config).tables["t"]
    assert sorted(map(str, project(numbers, tree.tables["t"], config, tree).collect())) == sorted(map(str, batch.collect())) and batch.where("note is null").count() > 3
