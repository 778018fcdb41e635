"""The programmatic surface: one call, a seeder with a chain, a context manager for tests, a pipeline."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, textpool
from .errors import ConfigInvalid, ConnectionFailed
from .operators.generate import Config, Generated, generate
from .operators.plan import insert_plan
from .schema import Schema, filter_schema
from .progress import Counted, Watch
from .scratch import materialise
from .sinks import sqltext
from .sinks.merge import Merged, merge_rows


@dataclass
class SeedResult:
    tables: dict[str, DataFrame]
    counts: dict[str, int]
    summary: sqltext.Summary
    warnings: list[str] = field(default_factory=list)


def run_pipeline(spark: SparkSession, schema: Schema, config: Config, existing=None, *, url=None, path=None, form="parquet", dry_run=False, batch=sqltext.BATCH, mode="errorifexists", only=None, unchanged=False, allowed=False, jdbc=None, progress=None, texts=None, text_cache=None, asking=None, watch=None, every=1.0) -> SeedResult:
    """Plan, generate, write. Without a target, tables come back as DataFrames.

    existing: tables by name, or "target" to read those that the URL holds (mode append). progress: called
    with (step, table, rows) when a table is planned and when it is written. texts: a provider of texts for
    the columns that hold prose (see textpool), asked for as many as each table gets rows; asking (textpool.Asking):
    by executors, many requests at once. watch: called with a Progress (rows written, rate, seconds left) at most every
    ``every`` seconds, and at each table's end. The summary counts rows as they were written.

    mode "merge" (Parquet folders): rows are merged into those that are there, by primary key, and only files that hold
    changed rows are replaced."""
    began = time.time()
    tell = progress or (lambda *_: None)
    unfilled = []
    if texts is not None:
        wanted = {schema.resolve(x) or x for x in only} if only is not None else set(schema.tables)
        sizes = {k: config.count(k) for k in wanted}
        pools, unfilled = textpool.ask_pools(spark, schema, texts, sizes, text_cache, asking) if asking else textpool.pool_tables(spark, schema, texts, sizes, text_cache)
        config = replace(config, text_pools={**pools, **config.text_pools})
    if existing == "target":
        existing = existing_of(spark, schema, url, allowed, **(jdbc or {})) if url and mode == "append" else None
    made: Generated = generate(spark, schema, config, existing, only, unchanged)
    made.warnings = [*made.warnings, *unfilled]
    for name, n in made.counts.items():
        tell("planned", name, n)
    how = sqltext.mode_of(dry_run, path, url)
    summary = sqltext.Summary(how, dict(made.counts), sum(len(v) for v in made.updates.values()), warnings=made.warnings)
    if how == "dry-run":
        summary.warnings = [*made.warnings, *sqltext.dry_run(made.tables, made.counts, batch)]
    else:
        summary.rows |= _write(spark, schema, made, how, Watch(spark, made.counts, watch, every), url=url, path=path, form=form, batch=batch, mode=mode, allowed=allowed, jdbc=jdbc or {}, warnings=summary.warnings)
    if how in ("file", "direct"):
        for name, n in summary.rows.items():
            tell("written", name, n)
    summary.seconds = time.time() - began
    return SeedResult(made.tables, made.counts, summary, made.warnings)


def _write(spark: SparkSession, schema: Schema, made: Generated, how: str, watch: Watch, *, url, path, form, batch, mode, allowed, jdbc, warnings: list[str]) -> dict[str, int]:
    """Rows written, by table."""
    order = made.plan.ordered
    if mode == "merge" and how != "frames":
        if how != "file" or form != "parquet":
            raise ConfigInvalid("only Parquet folders can be merged into", hints=("existingData: augment or truncate",))
        for name in [n for n in order if n in made.tables]:
            done: list[Merged] = []
            with watch.table(name, lambda done=done: done[0].same + done[0].changed + done[0].added):
                done.append(merge_rows(made.tables[name], f"{path}/{name}", list(schema.tables[name].primary_key)))
            m = done[0]
            warnings.append(f"{name}: {m.same} rows same, {m.changed} changed, {m.added} added, {m.gone} gone; {m.files_replaced} files replaced, {m.files_kept} kept")
        return watch.written
    if how == "file" and form == "sql":
        # Statements need the rows twice (to be ordered), so an observation would count them twice: what was made is told.
        sqltext.write_sql(schema, made.tables, order, path, batch, updates=made.updates, mode=mode, around=lambda n: watch.table(n, lambda: made.counts[n]))
        return watch.written
    if how == "frames":
        return {}
    counted = {n: Counted(df, n) for n, df in made.tables.items()}
    tables, around = {n: c.frame for n, c in counted.items()}, lambda n: watch.table(n, lambda: counted[n].rows)
    if how == "file":
        sqltext.write_frames(tables, path, form, mode, around)
    elif url.startswith("sqlite:"):
        return sqltext.write_sqlite(made.tables, order, sqlite_path(url), mode, lambda n: watch.table(n, lambda: made.counts[n]))
    else:
        sqltext.write_jdbc(tables, order, url, batch, mode, schema, allowed, around, **jdbc)
    return watch.written


def sqlite_path(url: str) -> str:
    return url.removeprefix("sqlite:").removeprefix("//")


def existing_of(spark: SparkSession, schema: Schema, url: str, allowed: bool = False, **options) -> dict[str, DataFrame]:
    """The tables of a schema as a URL's database holds them; those it lacks are left out."""
    from .sources import catalog

    if url.startswith("sqlite:"):
        return catalog.sqlite_tables(spark, sqlite_path(url), schema)
    out = {}
    for name in schema.tables:
        try:
            out[name] = catalog.read_jdbc(spark, url, name, allowed=allowed, **options)
        except ConnectionFailed:
            raise
        except Exception:  # noqa: BLE001, S112 - a table that isn't there has no rows
            continue
    return out


def seed(spark: SparkSession, schema: Schema | str, *, count: int = 50, seed: int = 42, exclude=(), only=(), rows_of=None, cardinality=None, existing=None, locale: str = "en", **target) -> SeedResult:
    if isinstance(schema, str):
        from .sources import parse_any

        schema = parse_any(schema)
    picked = filter_schema(schema, only, exclude).schema if exclude or only else schema
    config = Config(seed=seed, rows=count, rows_of=dict(rows_of or {}), cardinality=dict(cardinality or {}), locale=locale)
    return run_pipeline(spark, picked, config, existing, **target)


class Seeder:
    """Table after table; each call draws with a seed of its own, and sees what earlier calls made.

    Without a target, calls give DataFrames. With one (a folder, or a database URL), each call's rows are
    written there; ``teardown`` deletes them again, and only them: files that calls wrote, or rows by their primary
    key. Rows of a database's table without one can't be told from others, so such a call is refused. Between ``begin`` and ``commit`` calls are staged:
    nothing is written before the commit, and ``rollback`` forgets them."""

    def __init__(self, spark: SparkSession, schema: Schema, seed: int = 42, existing: dict[str, DataFrame] | None = None, *, path: str | None = None, url: str | None = None, allowed: bool = False, jdbc: dict | None = None, **options):
        self.spark, self.schema, self.first_seed, self.calls, self.options = spark, schema, seed, 0, options
        self.path, self.url, self.allowed, self.jdbc = path, url, allowed, jdbc or {}
        self.given = dict(existing or (existing_of(spark, schema, url, allowed, **self.jdbc) if url else {}))
        self.existing = {schema.resolve(k) or k: v for k, v in self.given.items()}
        self.written: list[tuple[str, DataFrame]] = []
        self.files: list[str] = []
        self.staged: list[tuple[str, DataFrame]] | None = None
        self.saved: tuple | None = None

    def seed(self, table: str, count: int = 50, *, overrides: dict[str, dict] | None = None, cardinality=None, seed: int | None = None) -> DataFrame:
        key = self.schema.resolve(table)
        if key is None:
            raise ConfigInvalid(f"no table {table}", hints=(f"tables: {', '.join(sorted(self.schema.tables))}",))
        if self.url and not self.schema.tables[key].primary_key:
            raise ConfigInvalid(f"{key} has no primary key, so teardown couldn't tell its rows from others", hints=("seed() writes them for good",))
        config = Config(seed=seed if seed is not None else self.first_seed + self.calls, rows_of={key: count}, cardinality={key: cardinality or {}}, overrides={key: overrides or {}}, **self.options)
        self.calls += 1
        made = generate(self.spark, self.schema, config, self.existing, [key]).tables[key]
        if self.path or self.url:
            # What is written is what later calls see: one table, computed once.
            made = materialise(made, "seeded")
        old = self.existing.get(key)
        self.existing[key] = made if old is None else old.unionByName(made, allowMissingColumns=True)
        if self.staged is not None:
            self.staged.append((key, made))
        else:
            self._write([(key, made)])
        return made

    def _write(self, made: list[tuple[str, DataFrame]]) -> None:
        for key, df in made:
            if self.path:
                self.files += files.add(df, f"{self.path}/{key}")
            elif self.url and self.url.startswith("sqlite:"):
                sqltext.write_sqlite({key: df}, [key], sqlite_path(self.url))
            elif self.url:
                sqltext.write_jdbc({key: df}, [key], self.url, schema=self.schema, allowed=self.allowed, **self.jdbc)
            self.written.append((key, df))

    def begin(self) -> None:
        self.saved, self.staged = (dict(self.existing), self.calls), []

    def commit(self) -> None:
        staged, self.staged, self.saved = self.staged or [], None, None
        self._write(staged)

    def rollback(self) -> None:
        if self.saved is not None:
            self.existing, self.calls = self.saved
        self.staged = self.saved = None

    def table(self, name: str, count: int = 50, **options) -> TableChain:
        return TableChain(self).table(name, count, **options)

    def teardown(self) -> None:
        """Delete what was written, children first, and forget what was made."""
        files.delete_files(self.spark, self.files)
        names = list(dict.fromkeys(k for k, _ in self.written)) if self.url and not self.path else []
        for key in reversed([k for k in insert_plan(self.schema).ordered if k in names]):
            columns = list(self.schema.tables[key].primary_key)
            keys = reduce(DataFrame.unionAll, [df.select(*columns) for k, df in self.written if k == key])
            sqltext.delete_rows(keys, key, columns, self.url, sqlite_path, self.allowed, **self.jdbc)
        self.written, self.files = [], []
        self.rollback()
        self.existing = {self.schema.resolve(k) or k: v for k, v in self.given.items()}
        self.calls = 0


class TableChain:
    def __init__(self, seeder: Seeder):
        self.seeder, self.steps = seeder, []

    def table(self, name: str, count: int = 50, **options) -> TableChain:
        self.steps.append((name, count, options))
        return self

    def execute(self) -> dict[str, DataFrame]:
        return {name: self.seeder.seed(name, count, **options) for name, count, options in self.steps}


@contextmanager
def with_seed(spark: SparkSession, schema: Schema, **options) -> Iterator[Seeder]:
    seeder = Seeder(spark, schema, **options)
    try:
        yield seeder
    finally:
        seeder.teardown()


def rows(tables: dict[str, DataFrame]) -> DataFrame:
    from .operators.existing import row_counts

    return row_counts(tables)


__all__ = ["Config", "F", "SeedResult", "Seeder", "TableChain", "replace", "rows", "run_pipeline", "seed", "with_seed"]
