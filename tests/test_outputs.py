"""Output modes, all-or-nothing writing, and a teardown that leaves the rows of others alone."""

import sqlite3
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from rowloom import api
from rowloom.errors import ConfigInvalid, OutputFailed
from rowloom.operators import generate
from rowloom.schema import Column, ForeignKey, Kind, Schema, Table
from rowloom.sinks import sqltext

KEY = Column("id", Kind.INTEGER, nullable=False, auto_increment=True)
SHOP = Schema.of(Table("parents", (KEY,), ("id",)), Table("children", (KEY, Column("p_id", Kind.INTEGER, nullable=False)), ("id",), (ForeignKey(("p_id",), "parents", ("id",)),)))
ONE = Schema.of(SHOP.tables["parents"])
DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def rows(spark, path):
    return spark.read.parquet(str(path)).count()


def test_teardown_leaves_rows_of_others(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.range(10).select(F.col("id").cast("int")).write.parquet(f"{out}/parents")
    with api.with_seed(spark, SHOP, path=out) as s:
        s.seed("parents", 5)
        assert rows(spark, f"{out}/parents") == 15
        spark.range(3).select(F.col("id").cast("int")).write.mode("append").parquet(f"{out}/parents")
        s.seed("children", 4)
    assert rows(spark, f"{out}/parents") == 13
    assert not (tmp_path / "out" / "children").exists()


def test_teardown_of_tables_without_keys_is_refused(spark, tmp_path):
    bare = Schema.of(Table("t", (Column("x", Kind.INTEGER),)))
    with api.with_seed(spark, bare, url=f"sqlite:{tmp_path / 'x.db'}") as s, pytest.raises(ConfigInvalid):
        s.seed("t", 3)
    with api.with_seed(spark, bare, path=str(tmp_path / "out")) as s:
        s.seed("t", 3)
        assert rows(spark, tmp_path / "out" / "t") == 3
    assert not (tmp_path / "out" / "t").exists()


def test_a_move_that_fails_takes_back_the_files_before_it(spark, tmp_path, monkeypatch):
    from rowloom import files

    calls, real = [], files.move

    def failing(spark, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise OutputFailed("full")
        real(spark, source, target)

    monkeypatch.setattr(files, "move", failing)
    with pytest.raises(OutputFailed):
        files.add(spark.range(8).repartition(4), str(tmp_path / "t"))
    assert len(calls) == 2 and [p for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")] == []


def test_sql_folders_by_mode(spark, tmp_path):
    out = str(tmp_path / "sql")
    names = lambda: sorted(p.name for p in (tmp_path / "sql").iterdir() if p.name[0] not in "._")
    write = lambda schema, mode, n=3: api.run_pipeline(spark, schema, generate.Config(rows=n), path=out, form="sql", mode=mode)
    write(SHOP, "errorifexists")
    assert names() == ["0000_parents", "0001_children"]
    with pytest.raises(OutputFailed):
        write(SHOP, "errorifexists")
    write(SHOP, "ignore", 9)
    write(ONE, "append")
    assert names() == ["0000_parents", "0001_children", "0002_parents"]
    (tmp_path / "sql" / "notes.txt").write_text("mine")
    write(ONE, "overwrite", 2)
    assert names() == ["0000_parents", "notes.txt"]
    text = "\n".join(r["value"] for r in spark.read.text(f"{out}/0000_parents").collect())
    assert text.count("INSERT") == 1 and text.count("(") - 1 - text.count("setval(") - text.count("pg_get_serial_sequence(") - text.count("COALESCE(") - text.count("MAX(") == 2


def test_sql_that_fails_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "sql")
    api.run_pipeline(spark, SHOP, generate.Config(rows=3), path=out, form="sql")
    made = generate.generate(spark, SHOP, generate.Config(rows=3))
    broken = dict(made.tables) | {"children": made.tables["children"].withColumn("p_id", F.raise_error(F.lit("broken")).cast("int"))}
    with pytest.raises(Exception, match="broken"):
        sqltext.write_sql(SHOP, broken, made.plan.ordered, out, mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "sql").iterdir() if not p.name.startswith(".")) == ["0000_parents", "0001_children"]


def test_sqlite_by_mode(spark, tmp_path):
    path = tmp_path / "x.db"
    with closing(sqlite3.connect(path)) as db:
        db.executescript("CREATE TABLE parents(id INTEGER PRIMARY KEY); CREATE TABLE children(id INTEGER PRIMARY KEY, p_id INTEGER NOT NULL REFERENCES parents); INSERT INTO parents VALUES (900)")

    def count(t):
        with closing(sqlite3.connect(path)) as db:
            return db.execute(f"SELECT count(*) FROM {t}").fetchone()[0]

    run = lambda mode, existing=None: api.run_pipeline(spark, SHOP, generate.Config(rows=5), existing, url=f"sqlite:{path}", mode=mode)
    with pytest.raises(OutputFailed):
        run("errorifexists")
    assert (count("parents"), count("children")) == (1, 0)
    run("append", "target")
    assert (count("parents"), count("children")) == (6, 5)
    with pytest.raises(OutputFailed):
        run("append")  # its keys 1 to 5 are new, but children's aren't: nothing goes in
    assert (count("parents"), count("children")) == (6, 5)
    run("overwrite")
    assert (count("parents"), count("children")) == (5, 5)
    run("ignore")
    assert (count("parents"), count("children")) == (5, 5)


def test_a_failing_partition_leaves_no_row(spark, tmp_path):
    """Nine partitions are fine, the tenth fails: in the embedded database and in SQLite."""
    fail = F.when(F.col("id") == 97, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("id").cast("int"))
    good = spark.range(5).select(F.col("id").cast("int"))
    bad = spark.range(0, 100, 1, 10).select(F.col("id").cast("int"), fail.alias("p_id"))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sqltext.run_jdbc(spark, url, ['CREATE TABLE parents ("id" INTEGER PRIMARY KEY)', 'CREATE TABLE children ("id" INTEGER PRIMARY KEY, "p_id" INTEGER)', "INSERT INTO parents VALUES (77)"], **DERBY)
    read = lambda t: spark.read.format("jdbc").options(url=url, dbtable=t, **DERBY).load()
    for mode in ("append", "overwrite"):
        with pytest.raises(OutputFailed):
            sqltext.write_jdbc({"parents": good, "children": bad}, ["parents", "children"], url, mode=mode, **DERBY)
        assert [r["id"] for r in read("parents").collect()] == [77] and read("children").isEmpty()
    # A constraint that only the last table breaks takes the first one's rows back too.
    twice = spark.createDataFrame([(1, 1), (1, 2)], "id int, p_id int")
    with pytest.raises(OutputFailed):
        sqltext.write_jdbc({"parents": good, "children": twice}, ["parents", "children"], url, **DERBY)
    assert read("parents").count() == 1
    tables = read("SYS.SYSTABLES").where("TABLETYPE = 'T'").select("TABLENAME").collect()
    assert {r[0] for r in tables} == {"PARENTS", "CHILDREN"}  # nothing is left beside them
    path = tmp_path / "x.db"
    with pytest.raises(OutputFailed):
        sqltext.write_sqlite({"parents": good, "children": bad}, ["parents", "children"], str(path))
    with closing(sqlite3.connect(path)) as db:
        assert db.execute("SELECT count(*) FROM sqlite_master").fetchone()[0] == 0


def test_deleting_rows_is_guarded_and_quotes_by_dialect(spark, monkeypatch):
    from rowloom.errors import ConnectionFailed

    keys = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ConnectionFailed):
        sqltext.delete_rows(keys, "t", ["id"], "mysql://db.prod.example.com/x", api.sqlite_path)
    ran = []
    monkeypatch.setattr(sqltext, "run_jdbc", lambda spark, link, statements, **o: ran.extend(statements))
    sqltext.delete_rows(keys, "t", ["id"], "mysql://localhost/x", api.sqlite_path)
    assert ran == ["DELETE FROM t WHERE (`id` = 1)"]
