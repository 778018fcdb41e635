"""SQL text, COPY lines and batches as Column expressions; files and databases as writers."""

from __future__ import annotations

import re
import uuid
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..errors import MissingTarget, OutputFailed
from ..operators.prefix import batch_number, ordinals
from ..schema import Schema, Table
from ..sources.catalog import guard

BATCH, LEAST_BATCH, MOST_BATCH = 500, 1, 10_000


def quoted(name: str, dialect: str = "postgres") -> str:
    q = "`" if dialect == "mysql" else '"'
    return ".".join(q + p.replace(q, q + q) + q for p in name.split("."))


def literal(c: Column, kind: T.DataType, dialect: str = "postgres") -> Column:
    """A value as SQL; NULL for null."""
    text = c.cast("string")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        out = text
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)
    elif isinstance(kind, T.BooleanType):
        out = F.when(c, "1" if dialect in ("mysql", "sqlite") else "TRUE").otherwise("0" if dialect in ("mysql", "sqlite") else "FALSE")
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("X'" if dialect != "postgres" else "'\\x"), F.lower(F.hex(c)), F.lit("'"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.lit("'"), moment_text(c, kind, dialect), F.lit("'"))
    elif isinstance(kind, T.ArrayType) and dialect == "postgres":
        out = F.concat(F.lit("'"), F.replace(array_text(c), F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        value = F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else text
        value = F.replace(value, F.lit("'"), F.lit("''"))
        if dialect == "mysql":
            value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
        out = F.concat(F.lit("'"), value, F.lit("'"))
    return F.coalesce(out, F.lit("NULL"))


def moment_text(c: Column, kind: T.DataType, dialect: str = "postgres") -> Column:
    """A moment as ISO text in UTC with its Z, whatever the session's zone; of a time without zone as it stands."""
    if isinstance(kind, T.TimestampType):
        # Seconds from the epoch, as no zone's missing or doubled hours come in.
        since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(c).cast("decimal(38,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
        c = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + since
    text = c.cast("string")
    day, clock = F.split_part(text, F.lit(" "), F.lit(1)), F.split_part(text, F.lit(" "), F.lit(2))
    if dialect == "mysql":
        return F.concat(day, F.lit(" "), F.substring(clock, 1, 8))
    thousandths = F.rpad(F.substring(clock, 10, 3), 3, "0")
    return F.concat(day, F.lit("T"), F.substring(clock, 1, 8), F.lit("."), thousandths, F.lit("Z" if isinstance(kind, T.TimestampType) else ""))


def array_text(c: Column) -> Column:
    """An array as {"a","b"}."""
    item = lambda x: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(x.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("NULL"))
    return F.concat(F.lit("{"), F.array_join(F.transform(c, item), ","), F.lit("}"))


def row_values(df: DataFrame, columns: list[str], dialect: str = "postgres") -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[literal(F.col(c), df.schema[c].dataType, dialect) for c in columns]), F.lit(")"))


def insert_head(table: str, columns: list[str], dialect: str = "postgres") -> str:
    return f"INSERT INTO {quoted(table, dialect)} ({', '.join(quoted(c, dialect) for c in columns)}) VALUES "


def insert_statements(df: DataFrame, table: str, columns: list[str], order: list[str], batch: int = BATCH, dialect: str = "postgres") -> DataFrame:
    """(batch, statement): multi-row INSERTs of ``batch`` rows, in the given order. Rows are made text before
    they are numbered, so wide rows move as one string; a statement's rows meet once more."""
    batch = max(LEAST_BATCH, min(MOST_BATCH, batch))
    texts = df.select(*[F.col(c) for c in order], row_values(df, columns, dialect).alias("__v"))
    rows = ordinals(texts, order, "__at", ["__v"], "zstd").select(batch_number(F.col("__at"), batch).alias("batch"), "__at", F.col("__v").alias("v"))
    grouped = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("__at", "v"))).alias("vs"))
    return grouped.select("batch", F.concat(F.lit(insert_head(table, columns, dialect)), F.array_join(F.transform("vs", lambda x: x["v"]), ", "), F.lit(";")).alias("statement"))


def update_statements(df: DataFrame, table: str, keys: list[str], sets: list[str], dialect: str = "postgres", keep: list[str] | None = None) -> DataFrame:
    """One UPDATE a row, beside the columns ``keep``."""
    is_ = lambda c: F.concat(F.lit(quoted(c, dialect)), F.coalesce(F.concat(F.lit(" = "), F.when(F.col(c).isNotNull(), literal(F.col(c), df.schema[c].dataType, dialect))), F.lit(" IS NULL")))
    assign = F.concat_ws(", ", *[F.concat(F.lit(f"{quoted(c, dialect)} = "), literal(F.col(c), df.schema[c].dataType, dialect)) for c in sets])
    return df.select(*(keep or []), F.concat(F.lit(f"UPDATE {quoted(table, dialect)} SET "), assign, F.lit(" WHERE "), F.concat_ws(" AND ", *[is_(c) for c in keys]), F.lit(";")).alias("statement"))


def copy_value(c: Column, kind: T.DataType) -> Column:
    """A COPY field: \\N for null, t and f, {..} for arrays, quotes where needed."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "t").otherwise("f")
    elif isinstance(kind, T.ArrayType):
        text = array_text(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = moment_text(c, kind)
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    elif isinstance(kind, (T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    text = F.when(text.rlike('[",\\n\\r\\\\]') | (text == ""), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.when(c.isNull(), "\\N").otherwise(text)


def copy_lines(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(",", *[copy_value(F.col(c), df.schema[c].dataType) for c in columns])


def sequence_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, next value) for sequences, after the rows are in."""
    got = df.agg(*[F.coalesce(F.max(c), F.lit(1)).cast("long").alias(c) for c in columns])
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.*")


def sequence_reset(table: str, column: str, dialect: str = "postgres") -> str:
    if dialect == "mysql":
        return f"ALTER TABLE {quoted(table, dialect)} AUTO_INCREMENT = 1;"
    return f"SELECT setval(pg_get_serial_sequence('{quoted(table)}', '{column}'), COALESCE(MAX({quoted(column)}), 1)) FROM {quoted(table)};"


def transaction(statements: list[str]) -> list[str]:
    return ["BEGIN;", *statements, "COMMIT;"]


def optimal_batch(columns: int | Column, width: int | Column | None = None):
    """Rows for a statement of about a megabyte, 100 to 5000; width: bytes a row, 30 a column by default."""
    if isinstance(columns, Column):
        size = (F.lit(30) * columns if width is None else width) + 3 * columns + 10
        return F.greatest(F.lit(100), F.least(F.lit(5000), F.floor(F.lit(1_000_000) / size))).cast("long")
    size = (30 * columns if width is None else width) + 3 * columns + 10
    return max(100, min(5000, 1_000_000 // size))


@dataclass
class Summary:
    mode: str
    rows: dict[str, int] = field(default_factory=dict)
    updates: int = 0
    sequences: int = 0
    seconds: float = 0.0
    warnings: list[str] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(self.rows.values())


def mode_of(dry_run: bool = False, path: str | None = None, url: str | None = None) -> str:
    return "dry-run" if dry_run else "file" if path else "direct" if url else "frames"


def untold(name: str):
    """What stands around the writing of a table where nobody watches it."""
    return nullcontext()


def write_frames(tables: dict[str, DataFrame], path: str, form: str = "parquet", mode: str = "errorifexists", around=untold) -> None:
    """One folder a table; Spark commits a table as a whole. around: a context for each table's name."""
    for name, df in tables.items():
        with around(name):
            writer = df.write.mode(mode)
            if form == "copy":
                df.select(copy_lines(df, df.columns).alias("value")).write.mode(mode).text(f"{path}/{name}")
            elif form == "csv":
                writer.csv(f"{path}/{name}", header=True, nullValue="\\N")
            else:
                writer.format(form).save(f"{path}/{name}")


LAST = 1 << 62  # behind all batches
#: Folders of SQL text: a number, which orders them, and a name.
SQL_FOLDER = re.compile(r"\d{4,}_.+")


def write_sql(schema: Schema, tables: dict[str, DataFrame], order: list[str], path: str, batch: int = BATCH, dialect: str = "postgres", updates: dict[str, list[DataFrame]] | None = None, mode: str = "errorifexists", around=untold) -> None:
    """One folder of SQL for each table, numbered in insert order; statements are written by executors, in
    order of batch, and files sort as their statements run. A table's part begins and ends its transaction,
    its sequences are set at its end. References that are filled later are NULL there, and the
    UPDATEs that fill them stand in folders behind all tables.

    mode: errorifexists (the default: nothing may be in the folder), ignore (then nothing is written), append (numbers
    go on behind the last folder's), overwrite (all numbered folders of earlier runs go, also those of tables
    that this run doesn't have; other files stay). Folders are written aside, and moved into place when all are whole, so a
    run that fails changes nothing."""
    updates = updates or {}
    names = [n for n in order if n in tables]
    if not names:
        return
    spark = tables[names[0]].sparkSession
    there = files.names(spark, path)
    if there and mode in ("errorifexists", "error", "default"):
        raise OutputFailed(f"{path} holds {', '.join(there[:3])}{' ...' if len(there) > 3 else ''}", hints=("existingData: augment or truncate, or an empty folder",))
    if there and mode == "ignore":
        return
    old = [n for n in there if SQL_FOLDER.fullmatch(n)]
    first = max([-1, *(int(n.split("_", 1)[0]) for n in old)]) + 1 if mode == "append" else 0
    aside, made = files.staging(path), []
    try:
        for name in names:
            df, t = tables[name], schema.tables[name]
            for later in updates.get(name, []):
                for c in later.columns:
                    if c not in t.primary_key and c in df.columns:
                        df = df.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
            keys = [c for c in (t.primary_key or tuple(df.columns)) if c in df.columns] or df.columns
            resets = [sequence_reset(name, c.name) for c in t.columns if c.auto_increment and dialect == "postgres"]
            frame = spark.createDataFrame([(-1, f"-- {name}\nBEGIN;"), (LAST, "\n".join([*resets, "COMMIT;"]))], "batch long, statement string")
            made.append(f"{first + len(made):04d}_{name}")
            with around(name):
                _write_ordered(insert_statements(df, name, df.columns, keys, batch, dialect).unionAll(frame), "batch", f"{aside}/{made[-1]}")
        for name, later in ((n, f) for n in names for f in updates.get(n, [])):
            t = schema.tables[name]
            keys = [c for c in t.primary_key if c in later.columns]
            sets = [c for c in later.columns if c not in t.primary_key]
            filled = later.where(" or ".join(f"`{c}` is not null" for c in sets))
            made.append(f"{first + len(made):04d}_{name}_updates")
            _write_ordered(update_statements(filled, name, keys, sets, dialect, keep=keys), *keys, f"{aside}/{made[-1]}")
        if mode == "overwrite":
            for n in old:
                files.delete(spark, f"{path}/{n}")
        for n in made:
            files.move(spark, f"{aside}/{n}", f"{path}/{n}")
    finally:
        files.delete(spark, aside)


def _write_ordered(statements: DataFrame, *by_and_path: str) -> None:
    *by, path = by_and_path
    statements.repartitionByRange(*by).sortWithinPartitions(*by).select("statement").write.text(path)


def run_jdbc(spark: SparkSession, url: str, statements: list[str], **options) -> None:
    """A few statements (keys and sequences, never rows) in one transaction on one connection."""
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, str(v))
    if options.get("driver"):
        spark._jvm.org.apache.spark.util.Utils.classForName(options["driver"], True, False)
    link = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        link.setAutoCommit(False)
        work = link.createStatement()
        for s in statements:
            work.execute(s)
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()


def jdbc_dialect(link: str) -> str:
    return "mysql" if ":mysql" in link or ":mariadb" in link else "sqlite" if ":sqlite" in link else "postgres"


def stage_like(table: str, aside: str, dialect: str) -> str:
    """An empty table with the columns of another, without its constraints."""
    return f"CREATE TABLE {aside} LIKE {table}" if dialect == "mysql" else f"CREATE TABLE {aside} AS SELECT * FROM {table} WITH NO DATA"


def write_jdbc(tables: dict[str, DataFrame], order: list[str], url: str, batch: int = BATCH, mode: str = "append", schema: Schema | None = None, allowed: bool = False, around=untold, **options) -> None:
    """All rows or none. Executors write each table's rows into a table beside it (Spark's writer, a partition a
    transaction), and when all are there, one transaction moves them in, parents first, and sets the
    sequences. Whatever fails before its commit (a partition, a constraint, a connection) leaves the target as it was; the
    tables beside it go in any case. References filled later are part of the rows already, so no updates follow.

    mode: append (augment), overwrite (rows of all tables go first, children before parents, in the same transaction;
    tables stay), errorifexists (no table may hold rows). Production hosts need ``allowed``."""
    if not url:
        raise MissingTarget("no connection URL")
    guard(url, allowed)
    names = [n for n in order if n in tables]
    if not names:
        return
    spark = tables[names[0]].sparkSession
    link = url if url.startswith("jdbc:") else f"jdbc:{url}"
    dialect = jdbc_dialect(link)
    reader = lambda n: spark.read.format("jdbc").options(url=link, dbtable=n, **options).load()
    if mode == "errorifexists":
        full = [n for n in names if not reader(n).limit(1).isEmpty()]
        if full:
            raise OutputFailed(f"{', '.join(full)} hold rows already", hints=("existingData: augment or truncate",))
    mark = uuid.uuid4().hex[:12]
    asides = {n: f"{n}_rl{mark}" for n in names}
    made: list[str] = []
    at = ""
    try:
        for at in names:
            run_jdbc(spark, link, [stage_like(at, asides[at], dialect)], **options)
            made.append(asides[at])
            with around(at):
                tables[at].write.format("jdbc").options(url=link, dbtable=asides[at], batchsize=str(batch), **options).mode("append").save()
        listed = {n: ", ".join(quoted(c, dialect) for c in tables[n].columns) for n in names}
        statements = [f"DELETE FROM {n}" for n in reversed(names)] if mode == "overwrite" else []
        statements += [f"INSERT INTO {n} ({listed[n]}) SELECT {listed[n]} FROM {asides[n]}" for n in names]
        if schema is not None and (":postgres" in link or dialect == "mysql"):
            # MySQL commits before an ALTER TABLE, so these come last.
            statements += [sequence_reset(n, c.name, dialect).rstrip(";") for n in names for c in schema.tables[n].columns if c.auto_increment]
        at = ", ".join(names)
        run_jdbc(spark, link, statements, **options)
    except Exception as e:
        raise OutputFailed(f"{at} can't be written: {e}", hints=("is the driver's jar on the class path?",)) from e
    finally:
        for n in made:
            run_jdbc(spark, link, [f"DROP TABLE {n}"], **options)


def _plain(df: DataFrame) -> DataFrame:
    """Columns as SQLite takes them."""
    nested, as_text = (T.ArrayType, T.MapType, T.StructType), (T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType, T.DayTimeIntervalType)
    kind = lambda c: df.schema[c].dataType
    return df.select(*[F.to_json(c).alias(c) if isinstance(kind(c), nested) else F.col(c).cast("string").alias(c) if isinstance(kind(c), as_text) else F.col(c) for c in df.columns])


def write_sqlite(tables: dict[str, DataFrame], order: list[str], path: str, mode: str = "append", around=untold) -> dict[str, int]:
    """A local file for tests and samples: rows stream to the driver, one partition at a time, into one transaction
    over all tables, so that a failure leaves the file as it was. mode: append (the file's rows stay), overwrite (rows of
    all tables go first, children before parents), errorifexists (no table may hold rows), ignore (tables that hold
    rows are left out)."""
    import sqlite3
    from contextlib import closing

    counts = {}
    names = [n for n in order if n in tables]
    short = {n: quoted(n.rsplit(".", 1)[-1]) for n in names}
    with closing(sqlite3.connect(path)) as db:
        there = {quoted(n) for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        full = [n for n in names if short[n] in there and db.execute(f"SELECT 1 FROM {short[n]} LIMIT 1").fetchone()]
        if full and mode in ("errorifexists", "error", "default"):
            raise OutputFailed(f"{', '.join(full)} hold rows already", hints=("existingData: augment or truncate",))
        if mode == "ignore":
            names = [n for n in names if n not in full]
        try:
            db.execute("BEGIN")  # creating tables is part of it
            if mode == "overwrite":
                for n in reversed(full):
                    db.execute(f"DELETE FROM {short[n]}")
            for name in names:
                df = tables[name]
                listed = ", ".join(quoted(c) for c in df.columns)
                db.execute(f"CREATE TABLE IF NOT EXISTS {short[name]} ({listed})")
                sql = f"INSERT INTO {short[name]} ({listed}) VALUES ({', '.join('?' * len(df.columns))})"
                counts[name] = 0
                with around(name):
                    for row in _plain(df).toLocalIterator():
                        db.execute(sql, tuple(row))
                        counts[name] += 1
            db.commit()
        except Exception as e:
            db.rollback()
            raise OutputFailed(f"{path} can't be written: {e}") from e
    return counts


def delete_rows(keys: DataFrame, table: str, columns: list[str], url: str, sqlite_path, allowed: bool = False, **options) -> None:
    """Rows of these primary keys go: statements of ``BATCH`` keys each, run from the driver in one
    transaction as they stream in, one partition of keys at a time. Production hosts need ``allowed``."""
    import itertools

    guard(url, allowed)
    link = url if url.startswith(("jdbc:", "sqlite:")) else f"jdbc:{url}"
    dialect = "sqlite" if url.startswith("sqlite:") else jdbc_dialect(link)
    condition = F.concat(F.lit("("), F.concat_ws(" AND ", *[F.concat(F.lit(f"{quoted(c, dialect)} = "), literal(F.col(c), keys.schema[c].dataType, dialect)) for c in columns]), F.lit(")"))
    rows = (r[0] for r in keys.select(condition).toLocalIterator())
    # JDBC names stand as the writer's dbtable does.
    statements = (f"DELETE FROM {quoted(table.rsplit('.', 1)[-1]) if dialect == 'sqlite' else table} WHERE {' OR '.join(some)}" for some in itertools.batched(rows, BATCH))
    if url.startswith("sqlite:"):
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(sqlite_path(url))) as db, db:
            for s in statements:
                db.execute(s)
        return
    run_jdbc(keys.sparkSession, link, statements, **options)


def dry_run(tables: dict[str, DataFrame], counts: dict[str, int], batch: int = BATCH) -> list[str]:
    return [f"{name}: {counts[name]} rows in {-(-counts[name] // batch)} statements" for name in tables]


def insertable_columns(t: Table, df: DataFrame) -> list[str]:
    return [c.name for c in t.columns if c.name in df.columns and not c.generated]
