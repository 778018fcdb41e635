"""Live sources: database kinds, native types, catalog rows, CHECK lists. Catalog queries go through any
reader Spark has (JDBC, tables, files); SQLite files are read by the standard library."""

from __future__ import annotations

import re

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConnectionFailed, UnknownSourceType
from ..schema import Check, Column, ForeignKey, Kind, Schema, Table

NATIVE = {
    "text": Kind.TEXT, "tinytext": Kind.TEXT, "mediumtext": Kind.TEXT, "longtext": Kind.TEXT, "citext": Kind.TEXT, "clob": Kind.TEXT, "character varying": Kind.VARCHAR, "varchar": Kind.VARCHAR, "nvarchar": Kind.VARCHAR, "character": Kind.CHAR,
    "char": Kind.CHAR, "bpchar": Kind.CHAR, "smallint": Kind.SMALLINT, "int2": Kind.SMALLINT, "tinyint": Kind.SMALLINT, "smallserial": Kind.SMALLINT, "year": Kind.SMALLINT, "integer": Kind.INTEGER, "int": Kind.INTEGER, "int4": Kind.INTEGER,
    "mediumint": Kind.INTEGER, "serial": Kind.INTEGER, "bigint": Kind.BIGINT, "int8": Kind.BIGINT, "bigserial": Kind.BIGINT, "real": Kind.REAL, "float4": Kind.REAL, "float": Kind.REAL, "double precision": Kind.DOUBLE, "double": Kind.DOUBLE,
    "float8": Kind.DOUBLE, "numeric": Kind.DECIMAL, "decimal": Kind.DECIMAL, "money": Kind.DECIMAL, "boolean": Kind.BOOLEAN, "bool": Kind.BOOLEAN, "bit": Kind.BOOLEAN, "date": Kind.DATE, "time": Kind.TIME, "timetz": Kind.TIME, "time without time zone": Kind.TIME,
    "timestamp": Kind.TIMESTAMP, "timestamp without time zone": Kind.TIMESTAMP, "datetime": Kind.TIMESTAMP, "timestamptz": Kind.TIMESTAMPTZ, "timestamp with time zone": Kind.TIMESTAMPTZ, "interval": Kind.INTERVAL, "json": Kind.JSON, "jsonb": Kind.JSONB,
    "uuid": Kind.UUID, "bytea": Kind.BYTEA, "blob": Kind.BYTEA, "longblob": Kind.BYTEA, "binary": Kind.BYTEA, "varbinary": Kind.BYTEA, "inet": Kind.INET, "cidr": Kind.CIDR, "macaddr": Kind.MACADDR, "array": Kind.ARRAY, "user-defined": Kind.ENUM,
    "enum": Kind.ENUM, "set": Kind.ENUM, "point": Kind.POINT, "line": Kind.LINE, "geometry": Kind.GEOMETRY, "vector": Kind.VECTOR,
}
PRODUCTION = re.compile(r"(^|[.-])(prod|production|live|primary|master)([.-]|\d*$)|\.rds\.amazonaws\.com$|\.database\.azure\.com$|\.supabase\.co$|\.neon\.tech$|\.render\.com$|\.railway\.app$|\.psdb\.cloud$", re.I)


def kind_of_native(native: str, dialect: str = "postgres") -> Kind:
    text = native.strip().lower()
    if dialect == "mysql" and re.match(r"tinyint\(1\)", text):
        return Kind.BOOLEAN
    if text.endswith("[]") or (text.startswith("_") and dialect == "postgres"):
        return Kind.ARRAY
    base = re.sub(r"\s*\(.*?\)", "", text).replace(" unsigned", "").strip()
    if dialect == "sqlite" and base not in NATIVE:
        for part, kind in (("bool", Kind.BOOLEAN), ("int", Kind.INTEGER), ("char", Kind.VARCHAR), ("clob", Kind.TEXT), ("text", Kind.TEXT), ("blob", Kind.BYTEA), ("real", Kind.DOUBLE), ("floa", Kind.DOUBLE), ("doub", Kind.DOUBLE), ("date", Kind.TIMESTAMP), ("dec", Kind.DECIMAL), ("num", Kind.DECIMAL)):
            if part in base:
                return kind
        return Kind.TEXT if not base else Kind.UNKNOWN
    return NATIVE.get(base, Kind.UNKNOWN)


def database_kind(url: str) -> str:
    u = url.strip().lower().removeprefix("jdbc:")
    for pattern, kind in ((r"postgres(ql)?:", "postgres"), (r"(mysql|mariadb):", "mysql"), (r"(sqlite|file):|.*\.(db|sqlite3?)$|:memory:$", "sqlite"), (r"(parquet|csv|json|orc):|.*\.(parquet|csv|json|orc)$", "files")):
        if re.match(pattern, u):
            return kind
    raise UnknownSourceType(f"no known database in {url}")


def is_production(host: str) -> bool:
    return bool(PRODUCTION.search(host)) and host not in ("localhost", "127.0.0.1", "::1")


def guard(url: str, allowed: bool = False) -> None:
    host = re.search(r"://(?:[^@/]*@)?([^:/?]+)", url)
    if host and is_production(host[1]) and not allowed:
        raise ConnectionFailed(f"{host[1]} looks like a production host", code="RL1006", hints=("pass allowed=True if it may be written",))


def literals(expression: str) -> tuple[str, ...]:
    """The texts an enumerating CHECK allows; none where it compares by order or has other parts."""
    if re.search(r"[<>]", expression) or not re.search(r"=\s*ANY|\bIN\s*\(|=\s*'", expression, re.I):
        return ()
    return tuple(dict.fromkeys(x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", expression)))


def literals_column(expression: SparkColumn) -> SparkColumn:
    """literals() over data: an array of the quoted texts, empty where there's an order comparison."""
    found = F.regexp_extract_all(expression, F.lit("'([^']*)'"), F.lit(1))
    return F.when(expression.rlike("[<>]"), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def enum_literals(native: str) -> tuple[str, ...]:
    m = re.match(r"(?:enum|set)\s*\((.*)\)$", native.strip(), re.I | re.S)
    return tuple(x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", m[1])) if m else ()


def with_check_values(table: Table) -> Table:
    """Columns take the values of the CHECK that names them, as a whole word."""
    from dataclasses import replace

    def one(c: Column) -> Column:
        found = next((k.values for k in table.checks if k.values and re.search(rf"(?<!\w){re.escape(c.name)}(?!\w)", k.expression)), ())
        return replace(c, values=found) if found and not c.values else c

    return replace(table, columns=tuple(map(one, table.columns)))


def ordered_lists(rows: DataFrame, by: list[str], value: str, order: str, out: str) -> DataFrame:
    """Catalog rows to ordered lists: keys with their columns, enums with their labels."""
    parts = F.sort_array(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*by).agg(F.transform(parts, lambda x: x[value]).alias(out))


def read_tables(spark: SparkSession, path: str, names: list[str], form: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.format(form).load(f"{path}/{n}.{form}") for n in names}


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    guard(url, options.pop("allowed", False))
    return spark.read.format("jdbc").options(url=url if url.startswith("jdbc:") else f"jdbc:{url}", dbtable=table, **options).load()


def schema_of_rows(columns: DataFrame, keys: DataFrame | None = None, foreign: DataFrame | None = None, dialect: str = "postgres") -> Schema:
    """A schema from information_schema-like rows: columns (table_name, column_name, ordinal_position,
    data_type, is_nullable, column_default), keys (table_name, column_name, position), foreign
    (constraint_name, table_name, column_name, position, ref_table, ref_column). Catalogs are small."""
    tables: dict[str, list[Column]] = {}
    for r in sorted(columns.collect(), key=lambda r: (r["table_name"], r["ordinal_position"])):
        default, native = r["column_default"], r["data_type"]
        length = re.search(r"char\w*\s*(?:varying)?\s*\((\d+)\)", native, re.I)
        auto = bool(default and re.match(r"nextval\(|auto_increment", default, re.I))
        tables.setdefault(r["table_name"], []).append(Column(r["column_name"], kind_of_native(native, dialect), native, str(r["is_nullable"]).upper() in ("YES", "TRUE", "1"), default is not None, default, auto, max_length=int(length[1]) if length else None, values=enum_literals(native)))
    pks: dict[str, list] = {}
    for r in keys.collect() if keys is not None else ():
        pks.setdefault(r["table_name"], []).append((r["position"], r["column_name"]))
    fks: dict[tuple, list] = {}
    for r in foreign.collect() if foreign is not None else ():
        fks.setdefault((r["table_name"], r["constraint_name"], r["ref_table"]), []).append((r["position"], r["column_name"], r["ref_column"]))
    own = lambda t: tuple(ForeignKey(tuple(c for _, c, _ in sorted(v)), ref, tuple(x for *_, x in sorted(v)), n) for (tt, n, ref), v in fks.items() if tt == t)
    return Schema.of(*(Table(t, tuple(cs), tuple(c for _, c in sorted(pks.get(t, []))), own(t)) for t, cs in tables.items()))


def sqlite_tables(spark: SparkSession, path: str, schema: Schema) -> dict[str, DataFrame]:
    """Rows of a local SQLite file, for tests and samples: they pass through the driver. Columns take the
    types of the schema; tables and columns that the file lacks are left out."""
    import sqlite3
    from contextlib import closing

    out = {}
    with closing(sqlite3.connect(path)) as db:
        for key, t in schema.tables.items():
            q = t.name.replace('"', '""')
            there = {r[1] for r in db.execute(f'PRAGMA table_info("{q}")').fetchall()}
            cols = [c for c in t.columns if c.name in there]
            if not cols:
                continue
            listed = ", ".join('"' + c.name.replace('"', '""') + '"' for c in cols)
            rows = [tuple(None if v is None else v if isinstance(v, bytes) else str(v) for v in r) for r in db.execute(f'SELECT {listed} FROM "{q}"')]
            shape = ", ".join(f"`{c.name}` {'binary' if c.kind is Kind.BYTEA else 'string'}" for c in cols)
            simple = (Kind.ARRAY, Kind.VECTOR, Kind.INTERVAL)
            out[key] = spark.createDataFrame(rows, shape).select(*[F.col(f"`{c.name}`") if c.kind in simple else F.col(f"`{c.name}`").cast(c.spark_type()).alias(c.name) for c in cols])
    return out


def sqlite_schema(path: str) -> Schema:
    import sqlite3
    from contextlib import closing

    tables = []
    with closing(sqlite3.connect(path)) as db:
        for name, sql in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            q = name.replace('"', '""')
            info = db.execute(f'PRAGMA table_xinfo("{q}")').fetchall()
            pk = [c for _, c in sorted((r[5], r[1]) for r in info if r[5])]
            cols = []
            for _, c, native, notnull, default, is_pk, hidden in info:
                size = [int(x) for x in re.findall(r"\d+", native)]
                kind = kind_of_native(native, "sqlite")
                auto = bool(is_pk) and len(pk) == 1 and native.upper() == "INTEGER"
                cols.append(Column(c, kind, native, not notnull and not is_pk, default is not None, default, auto, hidden in (2, 3), size[0] if size and kind in (Kind.VARCHAR, Kind.CHAR) else None, *(size if len(size) == 2 else (None, None))))
            keys: dict[int, list] = {}
            for number, at, ref, col, to, upd, dele, _ in db.execute(f'PRAGMA foreign_key_list("{q}")').fetchall():
                keys.setdefault(number, []).append((at, ref, col, to or "", upd, dele))
            fks = tuple(ForeignKey(tuple(x[2] for x in sorted(v)), v[0][1], tuple(x[3] for x in sorted(v)), on_delete=v[0][5], on_update=v[0][4]) for v in keys.values())
            uniques = tuple(tuple(r[2] for r in db.execute(f'PRAGMA index_info("{i[1]}")').fetchall()) for i in db.execute(f'PRAGMA index_list("{q}")').fetchall() if i[2] and i[3] != "pk")
            checks = []
            for m in re.finditer(r"CHECK\s*\(", sql or "", re.I):
                from .scan import balanced

                body = sql[m.end() : balanced(sql, m.end() - 1) - 1]
                checks.append(Check(body, literals(body)))
            tables.append(with_check_values(Table(name, tuple(cols), tuple(pk), fks, uniques, tuple(checks))))
    # A reference without named columns is to the primary key.
    by = {t.name: t for t in tables}
    from dataclasses import replace

    fixed = [replace(t, foreign_keys=tuple(fk if all(fk.references) else replace(fk, references=by[fk.table].primary_key) for fk in t.foreign_keys)) for t in tables]
    return Schema.of(*fixed, name="sqlite")
