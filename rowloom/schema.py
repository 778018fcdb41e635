"""The data model: tables, columns, keys and constraints, and its bridge to Spark types."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import FilterInvalid

Kind = StrEnum(
    "Kind",
    "TEXT VARCHAR CHAR SMALLINT INTEGER BIGINT REAL DOUBLE DECIMAL BOOLEAN DATE TIME TIMESTAMP TIMESTAMPTZ INTERVAL JSON JSONB UUID BYTEA INET CIDR MACADDR ARRAY ENUM POINT LINE GEOMETRY VECTOR UNKNOWN".split(),
)


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind = Kind.TEXT
    native: str = ""
    nullable: bool = True
    has_default: bool = False
    default: str | None = None
    auto_increment: bool = False
    generated: bool = False
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    values: tuple[str, ...] = ()
    comment: str | None = None

    def spark_type(self) -> T.DataType:
        match self.kind:
            case Kind.SMALLINT:
                return T.ShortType()
            case Kind.INTEGER:
                return T.IntegerType()
            case Kind.BIGINT:
                return T.LongType()
            case Kind.REAL:
                return T.FloatType()
            case Kind.DOUBLE:
                return T.DoubleType()
            case Kind.DECIMAL:
                return T.DecimalType(self.precision or 10, 2 if self.scale is None else self.scale)
            case Kind.BOOLEAN:
                return T.BooleanType()
            case Kind.DATE:
                return T.DateType()
            case Kind.TIMESTAMP:
                return T.TimestampNTZType()
            case Kind.TIMESTAMPTZ:
                return T.TimestampType()
            case Kind.INTERVAL:
                return T.DayTimeIntervalType()
            case Kind.BYTEA:
                return T.BinaryType()
            case Kind.ARRAY:
                return T.ArrayType(T.StringType())
            case Kind.VECTOR:
                return T.ArrayType(T.FloatType())
        return T.StringType()


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    name: str = ""
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    deferrable: bool = False
    virtual: bool = False


@dataclass(frozen=True)
class Check:
    expression: str
    values: tuple[str, ...] = ()
    name: str = ""


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: tuple[Check, ...] = ()
    indexes: tuple[Index, ...] = ()
    schema: str = ""
    comment: str | None = None

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def struct(self) -> T.StructType:
        meta = lambda c: {k: v for k, v in (("max_length", c.max_length), ("enum_values", list(c.values) or None), ("kind", str(c.kind))) if v}
        return T.StructType([T.StructField(c.name, c.spark_type(), c.nullable, meta(c)) for c in self.columns])


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    name: str = ""

    @classmethod
    def of(cls, *tables: Table, enums: dict | None = None, name: str = "") -> Schema:
        return cls({t.full_name: t for t in tables}, dict(enums or {}), name)

    def resolve(self, name: str) -> str | None:
        """The key of a table named with or without its schema."""
        if name in self.tables:
            return name
        bare = name.rsplit(".", 1)[-1]
        found = [k for k in self.tables if k.rsplit(".", 1)[-1] == bare and ("." not in name or "." not in k)]
        return found[0] if len(found) == 1 else None


KIND_OF_SPARK = {
    "string": Kind.TEXT, "smallint": Kind.SMALLINT, "tinyint": Kind.SMALLINT, "int": Kind.INTEGER, "bigint": Kind.BIGINT, "float": Kind.REAL, "double": Kind.DOUBLE, "boolean": Kind.BOOLEAN,
    "date": Kind.DATE, "timestamp": Kind.TIMESTAMPTZ, "timestamp_ntz": Kind.TIMESTAMP, "binary": Kind.BYTEA, "array<float>": Kind.VECTOR,
}


def table_from_frame(name: str, df: DataFrame, primary_key: Iterable[str] = (), foreign_keys: Iterable[ForeignKey] = (), uniques=()) -> Table:
    """The catalog source for any table Spark can read: columns and types from its schema."""
    cols = []
    for f in df.schema:
        text = f.dataType.simpleString()
        kind = Kind.DECIMAL if text.startswith("decimal") else Kind.ARRAY if text.startswith("array") and text != "array<float>" else KIND_OF_SPARK.get(text, Kind.UNKNOWN)
        p, s = (f.dataType.precision, f.dataType.scale) if kind is Kind.DECIMAL else (None, None)
        cols.append(Column(f.name, kind, text, f.nullable, precision=p, scale=s, max_length=f.metadata.get("max_length"), values=tuple(f.metadata.get("enum_values", ()))))
    return Table(name, tuple(cols), tuple(primary_key), tuple(foreign_keys), tuple(tuple(u) for u in uniques))


# --- filters


def glob_regex(pattern: str) -> str:
    """* and ? stay inside one name part; everything else is literal; case counts."""
    return "^" + "".join("[^.]*" if c == "*" else "[^.]" if c == "?" else re.escape(c) for c in pattern) + "$"


def excluded(name: str, patterns: Iterable[str]) -> bool:
    bare = name.rsplit(".", 1)[-1]
    return any(re.match(glob_regex(p), n) for p in patterns for n in (name, bare))


def ancestors(schema: Schema, names: Iterable[str]) -> set[str]:
    """Tables that these reference, directly or not."""
    seen: set[str] = set()
    todo = list(names)
    while todo:
        for fk in schema.tables[todo.pop()].foreign_keys:
            key = schema.resolve(fk.table)
            if key and key not in seen:
                seen.add(key)
                todo.append(key)
    return seen


@dataclass
class FilterResult:
    schema: Schema
    selected: list[str]
    auto_included: list[str]
    excluded: list[str]
    missing: list[str]


def filter_schema(schema: Schema, only: Iterable[str] = (), exclude: Iterable[str] = (), with_ancestors: bool = True, strict: bool = False) -> FilterResult:
    only, exclude = list(only), list(exclude)
    found = {n: schema.resolve(n) for n in only}
    missing = [n for n, k in found.items() if k is None]
    if missing:
        raise FilterInvalid(f"no such table: {', '.join(missing)}", code="RL5008", hints=(f"tables: {', '.join(sorted(schema.tables))}",))
    picked = {k for k in found.values() if k} if only else set(schema.tables)
    more = ancestors(schema, picked) - picked if with_ancestors else set()
    if strict and more:
        raise FilterInvalid(f"referenced tables aren't selected: {', '.join(sorted(more))}", code="RL5009")
    out = sorted(k for k in picked | more if excluded(k, exclude))
    keep = (picked | more) - set(out)
    kept = Schema({k: t for k, t in schema.tables.items() if k in keep}, dict(schema.enums), schema.name)
    for k, t in kept.tables.items():
        kept.tables[k] = replace(t, foreign_keys=tuple(fk for fk in t.foreign_keys if kept.resolve(fk.table)))
    return FilterResult(kept, sorted(picked & keep), sorted(more & keep), out, missing)


# --- reports


def edges_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [(k, schema.resolve(fk.table) or fk.table, ",".join(fk.columns), all(t.column(c).nullable for c in fk.columns)) for k, t in schema.tables.items() for fk in t.foreign_keys]
    return spark.createDataFrame(rows, "child string, parent string, columns string, nullable boolean")


def columns_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = []
    for k, t in schema.tables.items():
        fks = {c for fk in t.foreign_keys for c in fk.columns}
        single = {u[0] for u in t.uniques if len(u) == 1}
        rows += [(k, i, c.name, str(c.kind), c.nullable, c.name in t.primary_key, c.name in fks, c.name in single, c.auto_increment, c.generated) for i, c in enumerate(t.columns)]
    return spark.createDataFrame(rows, "table string, position int, column string, kind string, nullable boolean, is_pk boolean, is_fk boolean, is_unique boolean, is_auto boolean, is_generated boolean")


def inspect(spark: SparkSession, schema: Schema) -> DataFrame:
    """One row a table: columns, outgoing and incoming references, and its place in the insert order."""
    from .operators.plan import insert_plan

    order = {k: i for i, k in enumerate(insert_plan(schema).ordered)}
    tables = spark.createDataFrame([(k, len(t.columns), ",".join(t.primary_key), order.get(k)) for k, t in schema.tables.items()], "table string, n_columns int, primary_key string, insert_order int")
    edges = edges_frame(spark, schema)
    out = edges.groupBy(F.col("child").alias("table")).agg(F.count("*").alias("references"))
    into = edges.groupBy(F.col("parent").alias("table")).agg(F.count("*").alias("referenced_by"))
    return tables.join(out, "table", "left").join(into, "table", "left").na.fill(0, ["references", "referenced_by"])


def format_report(rows: DataFrame) -> str:
    got = rows.orderBy("insert_order").collect()
    wide = max([5, *(len(r["table"]) for r in got)])
    return "\n".join([f"{'table':<{wide}}  columns  refs  used by", *(f"{r['table']:<{wide}}  {r['n_columns']:>7}  {r['references']:>4}  {r['referenced_by']:>7}" for r in got)])
