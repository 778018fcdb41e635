"""Row-level regeneration, and progress by written rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from rowloom import api, files, progress
from rowloom.errors import ConfigInvalid, OutputFailed
from rowloom.operators import generate
from rowloom.schema import Column, ForeignKey, Kind, Schema, Table
from rowloom.sinks.merge import Merged, merge_rows

KEY = Column("id", Kind.INTEGER, nullable=False, auto_increment=True)


def content(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(str(path)).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, a string, b array<int>")


def test_only_files_with_changed_rows_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"v{i}", [i]) for i in range(100)]
    df = frame(spark, rows).repartitionByRange(5, "id").sortWithinPartitions("id")
    df.write.parquet(path)
    before = files.names(spark, path)
    assert len(before) == 5
    assert merge_rows(df, path, ["id"]) == Merged(100, files_kept=5) and files.names(spark, path) == before
    # A change, a null, one gone and two new: of the first three, two are in one file.
    new = [(i, None if i == 3 else "other" if i == 1 else a, b) for i, a, b in rows if i != 99] + [(200, "x", None), (201, None, [1])]
    got = merge_rows(frame(spark, new), path, ["id"])
    assert got == Merged(97, 2, 2, 1, 2, 3)
    assert content(spark, path) == sorted(tuple(r) for r in frame(spark, new).collect())
    after = files.names(spark, path)
    assert len(set(after) & set(before)) == 3
    # New rows alone replace no file.
    more = [*new, (300, "y", [])]
    assert merge_rows(frame(spark, more), path, ["id"]) == Merged(101, added=1, files_kept=len(after)) and set(after) <= set(files.names(spark, path))


def test_rows_left_twice_are_mended(spark, tmp_path):
    """As a run leaves them that was cut off between the files that come and those that go."""
    path = str(tmp_path / "t")
    df = frame(spark, [(i, f"v{i}", [i]) for i in range(20)])
    df.coalesce(1).write.parquet(path)
    df.where("id < 5").coalesce(1).write.mode("append").parquet(path)
    merge_rows(df, path, ["id"])
    assert content(spark, path) == sorted(tuple(r) for r in df.collect())


def test_other_columns_no_folder_and_no_key(spark, tmp_path):
    path = str(tmp_path / "t")
    df = frame(spark, [(1, "x", [1]), (2, "y", None)])
    assert merge_rows(df, path, ["id"]) == Merged(added=2)
    assert merge_rows(df.drop("b"), path, ["id"]).added == 2
    assert spark.read.parquet(path).columns == ["id", "a"] and spark.read.parquet(path).count() == 2
    assert merge_rows(df.drop("b").limit(0), path, ["id"]).gone == 2
    with pytest.raises(OutputFailed):
        merge_rows(df, path, [])
    s = Schema.of(Table("t", (KEY,), ("id",)))
    for target in ({"url": f"sqlite:{tmp_path / 'x.db'}"}, {"path": str(tmp_path / "sql"), "form": "sql"}):
        with pytest.raises(ConfigInvalid):
            api.run_pipeline(spark, s, generate.Config(rows=2), mode="merge", **target)


def test_one_changed_table_of_many_replaces_its_files_only(spark, tmp_path):
    tables = [Table("t0", (KEY, Column("v", Kind.INTEGER)), ("id",))]
    for k in range(1, 14):
        tables.append(Table(f"t{k}", (KEY, Column("p", Kind.INTEGER, nullable=False), Column("v", Kind.INTEGER)), ("id",), (ForeignKey(("p",), f"t{k - 1}", ("id",)),)))
    out, config = str(tmp_path / "out"), generate.Config(rows=12)
    api.run_pipeline(spark, Schema.of(*tables), config, path=out, mode="merge")
    before = {f"t{k}": files.names(spark, f"{out}/t{k}") for k in range(14)}
    changed = Schema.of(*tables[:7], Table("t7", (*tables[7].columns[:2], Column("v", Kind.INTEGER, values=("7",))), ("id",), tables[7].foreign_keys), *tables[8:])
    got = api.run_pipeline(spark, changed, config, path=out, mode="merge")
    after = {f"t{k}": files.names(spark, f"{out}/t{k}") for k in range(14)}
    assert [t for t in before if before[t] != after[t]] == ["t7"] and got.summary.total == 14 * 12
    assert spark.read.parquet(f"{out}/t7").where("v <> 7").count() == 0 and len(got.summary.warnings) == 14


def test_summaries_count_written_rows(spark, tmp_path):
    s = Schema.of(Table("a", (KEY,), ("id",)), Table("b", (KEY, Column("p", Kind.INTEGER, nullable=False)), ("id",), (ForeignKey(("p",), "a", ("id",)),)))
    seen = []
    got = api.run_pipeline(spark, s, generate.Config(rows_of={"a": 300, "b": 700}), path=str(tmp_path / "p"), watch=seen.append, every=60.0)
    assert got.summary.rows == {"a": 300, "b": 700}
    ends = [(p.table, p.done, p.total) for p in seen]
    assert ends[-1] == ("b", 1000, 1000) and ("a", 300, 1000) in ends and all(p.seconds > 0 and p.rate > 0 for p in seen if p.done)
    assert "1000 of 1000 rows (100 %)" in seen[-1].line() and seen[-1].left == 0
    counted = progress.Counted(spark.range(77).where("id % 2 = 0"), "x")
    counted.frame.write.parquet(str(tmp_path / "q"))
    assert counted.rows == 39


def test_callbacks_are_throttled(spark):
    now, seen = itertools.count(), []
    watch = progress.Watch(spark, {"t": 100}, seen.append, every=5, clock=lambda: next(now))
    for k in range(20):
        watch.say("t", k)
    assert 3 <= len(seen) <= 5
    watch.say("t", 50, force=True)
    assert seen[-1].done == 50 and seen[-1].left > 0
    silent = progress.Watch(spark, {"t": 1}, None)
    with silent.table("t", lambda: 1):
        pass
    assert silent.written == {"t": 1}


def test_a_watch_tells_while_a_table_is_written(spark, tmp_path):
    seen = []
    watch = progress.Watch(spark, {"t": 8000}, seen.append, every=0.05)
    slow = spark.range(0, 8000, 1, 40).where(F.expr("java_method('java.lang.Math', 'abs', cast(id as int)) >= 0")).repartition(60)
    with watch.table("t", lambda: 8000):
        slow.mapInPandas(lambda it: ((__import__("time").sleep(0.02), b)[1] for b in it), "id long").write.parquet(str(tmp_path / "t"))
    assert len(seen) > 2 and seen[-1].done == 8000 and all(0 <= p.done <= 8000 for p in seen)
