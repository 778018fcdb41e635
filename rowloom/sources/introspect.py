"""Schemas of live databases: one flat result for columns, enumerations and constraints from each kind of
catalog, folded by DataFrame operations and put together as a Schema.

Catalogs are read by any reader Spark has; ``introspect`` uses JDBC (the driver's jar is the user's), tests
read saved rows. Catalogs are metadata: what is collected is a row for each column and constraint.

columns       table_name, column_name, position, data_type, nullable, column_default, identity, generated, enum_name, comment
enums         enum_name, label, position
constraints   table_name, constraint_name, kind, column_name, position, ref_table, ref_column, on_delete, on_update, deferrable, expression
              kind: p primary key, u unique constraint, i unique index, f foreign key, c check
"""

from __future__ import annotations

import re

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IntrospectionFailed
from ..schema import Check, Column, ForeignKey, Index, Kind, Schema, Table
from .catalog import database_kind, enum_literals, guard, kind_of_native, literals, sqlite_schema, with_check_values

POSTGRES = {
    "columns": """
        SELECT rel.relname AS table_name, att.attname AS column_name, CAST(att.attnum AS integer) AS position, format_type(att.atttypid, att.atttypmod) AS data_type,
               NOT att.attnotnull AS nullable, pg_get_expr(def.adbin, def.adrelid) AS column_default, CAST(att.attidentity AS text) AS identity, att.attgenerated <> '' AS generated,
               CASE WHEN typ.typtype = 'e' THEN typ.typname END AS enum_name, col_description(rel.oid, att.attnum) AS comment
        FROM pg_class rel JOIN pg_namespace space ON space.oid = rel.relnamespace JOIN pg_attribute att ON att.attrelid = rel.oid JOIN pg_type typ ON typ.oid = att.atttypid
             LEFT JOIN pg_attrdef def ON def.adrelid = rel.oid AND def.adnum = att.attnum
        WHERE space.nspname = '{schema}' AND rel.relkind IN ('r', 'p') AND NOT rel.relispartition AND att.attnum > 0 AND NOT att.attisdropped""",
    "enums": """
        SELECT typ.typname AS enum_name, lab.enumlabel AS label, CAST(lab.enumsortorder AS double precision) AS position
        FROM pg_enum lab JOIN pg_type typ ON typ.oid = lab.enumtypid JOIN pg_namespace space ON space.oid = typ.typnamespace WHERE space.nspname = '{schema}'""",
    "constraints": """
        SELECT rel.relname AS table_name, con.conname AS constraint_name, CAST(con.contype AS text) AS kind, att.attname AS column_name, CAST(k.place AS integer) AS position,
               other.relname AS ref_table, far.attname AS ref_column, CAST(con.confdeltype AS text) AS on_delete, CAST(con.confupdtype AS text) AS on_update, con.condeferrable AS deferrable,
               CASE WHEN con.contype = 'c' THEN pg_get_expr(con.conbin, con.conrelid) END AS expression
        FROM pg_constraint con JOIN pg_class rel ON rel.oid = con.conrelid JOIN pg_namespace space ON space.oid = rel.relnamespace
             LEFT JOIN LATERAL unnest(con.conkey) WITH ORDINALITY AS k(num, place) ON true LEFT JOIN pg_attribute att ON att.attrelid = con.conrelid AND att.attnum = k.num
             LEFT JOIN pg_class other ON other.oid = con.confrelid LEFT JOIN pg_attribute far ON far.attrelid = con.confrelid AND far.attnum = con.confkey[k.place]
        WHERE space.nspname = '{schema}' AND con.contype IN ('p', 'u', 'f', 'c')
        UNION ALL
        SELECT rel.relname, ind.relname, 'i', att.attname, CAST(k.place AS integer), NULL, NULL, NULL, NULL, false, NULL
        FROM pg_index x JOIN pg_class rel ON rel.oid = x.indrelid JOIN pg_class ind ON ind.oid = x.indexrelid JOIN pg_namespace space ON space.oid = rel.relnamespace
             JOIN LATERAL unnest(x.indkey) WITH ORDINALITY AS k(num, place) ON k.place <= x.indnkeyatts JOIN pg_attribute att ON att.attrelid = x.indrelid AND att.attnum = k.num
        WHERE space.nspname = '{schema}' AND x.indisunique AND x.indpred IS NULL AND x.indexprs IS NULL AND NOT EXISTS (SELECT 1 FROM pg_constraint own WHERE own.conindid = x.indexrelid)""",
}
MYSQL = {
    "columns": """
        SELECT c.table_name AS table_name, c.column_name AS column_name, c.ordinal_position AS position, c.column_type AS data_type, c.is_nullable = 'YES' AS nullable, c.column_default AS column_default,
               CASE WHEN c.extra LIKE '%auto_increment%' THEN 'd' ELSE '' END AS identity, c.generation_expression <> '' AS generated, NULL AS enum_name, c.column_comment AS comment
        FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name
        WHERE c.table_schema = '{schema}' AND t.table_type = 'BASE TABLE'""",
    "constraints": """
        SELECT k.table_name AS table_name, k.constraint_name AS constraint_name, CASE t.constraint_type WHEN 'PRIMARY KEY' THEN 'p' WHEN 'UNIQUE' THEN 'u' ELSE 'f' END AS kind, k.column_name AS column_name,
               k.ordinal_position AS position, k.referenced_table_name AS ref_table, k.referenced_column_name AS ref_column, r.delete_rule AS on_delete, r.update_rule AS on_update, false AS deferrable, NULL AS expression
        FROM information_schema.key_column_usage k
             JOIN information_schema.table_constraints t ON t.table_schema = k.table_schema AND t.table_name = k.table_name AND t.constraint_name = k.constraint_name
             LEFT JOIN information_schema.referential_constraints r ON r.constraint_schema = k.table_schema AND r.table_name = k.table_name AND r.constraint_name = k.constraint_name
        WHERE k.table_schema = '{schema}'
        UNION ALL
        SELECT t.table_name, c.constraint_name, 'c', NULL, NULL, NULL, NULL, NULL, NULL, false, c.check_clause
        FROM information_schema.check_constraints c JOIN information_schema.table_constraints t ON t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name
        WHERE c.constraint_schema = '{schema}'""",
}
QUERIES = {"postgres": POSTGRES, "mysql": MYSQL}
ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}


def catalog_sql(dialect: str, schema: str) -> dict[str, str]:
    """The catalog's queries, whose results have the columns above. Schema names are plain words."""
    if not re.fullmatch(r"[\w$-]+", schema):
        raise IntrospectionFailed(f"no schema name: {schema}")
    return {k: q.replace("{schema}", schema) for k, q in QUERIES[dialect].items()}


def key_lists(constraints: DataFrame) -> DataFrame:
    """One row for each key: its columns, and those that it references, in their order."""
    parts = F.sort_array(F.collect_list(F.struct("position", "column_name", "ref_column")))
    keys = constraints.where("kind <> 'c'").groupBy("table_name", "constraint_name", "kind", "ref_table").agg(
        parts.alias("parts"), F.min("on_delete").alias("on_delete"), F.min("on_update").alias("on_update"), F.max("deferrable").alias("deferrable")
    )
    return keys.select(
        "table_name", "constraint_name", "kind", F.transform("parts", lambda p: p["column_name"]).alias("columns"), "ref_table",
        F.filter(F.transform("parts", lambda p: p["ref_column"]), lambda c: c.isNotNull()).alias("references"), action("on_delete").alias("on_delete"), action("on_update").alias("on_update"), "deferrable",
    )


def action(c: str) -> SparkColumn:
    """What a reference does, by its catalog's letter or words."""
    out = F.upper(F.col(c))
    for letter, words in ACTIONS.items():
        out = F.when(F.col(c) == letter, words).otherwise(out)
    return F.coalesce(out, F.lit("NO ACTION"))


def check_lists(constraints: DataFrame) -> DataFrame:
    """(table_name, constraint_name, expression), a check over several columns once."""
    return constraints.where("kind = 'c' and expression is not null").groupBy("table_name", "constraint_name").agg(F.min("expression").alias("expression"))


def enum_lists(enums: DataFrame) -> DataFrame:
    """(enum_name, labels) in the enumeration's own order."""
    labels = F.sort_array(F.collect_list(F.struct("position", "label")))
    return enums.groupBy("enum_name").agg(F.transform(labels, lambda x: x["label"]).alias("labels"))


def _column(r, labels: dict[str, tuple[str, ...]], dialect: str) -> Column:
    native, default = r["data_type"], r["column_default"]
    listed = labels.get(r["enum_name"] or "", ()) or enum_literals(native)
    kind = Kind.ENUM if listed else kind_of_native(native, dialect)
    sizes = [int(x) for x in re.findall(r"\d+", m[1])] if (m := re.search(r"\(([\d, ]+)\)", native)) else []
    length = sizes[0] if sizes and (kind in (Kind.VARCHAR, Kind.CHAR, Kind.VECTOR)) else None
    precision, scale = ((sizes[0], sizes[1] if len(sizes) > 1 else 0) if sizes else (None, None)) if kind is Kind.DECIMAL else (None, None)
    auto = bool(r["identity"]) or bool(default and re.match(r"nextval\(", default, re.I))
    return Column(r["column_name"], kind, native, bool(r["nullable"]), default is not None, default, auto, bool(r["generated"]), length, precision, scale, listed, r["comment"] or None)


def schema_of_catalog(columns: DataFrame, constraints: DataFrame, enums: DataFrame | None = None, dialect: str = "postgres") -> Schema:
    """The Schema that catalog rows describe. An identity column that is always generated is left to the database
    like one that counts up; checks that list values bind them to their columns."""
    labels = {r["enum_name"]: tuple(r["labels"]) for r in enum_lists(enums).collect()} if enums is not None else {}
    cols: dict[str, list[Column]] = {}
    for r in columns.orderBy("table_name", "position").collect():
        cols.setdefault(r["table_name"], []).append(_column(r, labels, dialect))
    keys: dict[str, list] = {}
    for r in key_lists(constraints).orderBy("table_name", "constraint_name").collect():
        keys.setdefault(r["table_name"], []).append(r)
    checks: dict[str, list[Check]] = {}
    for r in check_lists(constraints).orderBy("table_name", "constraint_name").collect():
        checks.setdefault(r["table_name"], []).append(Check(r["expression"], literals(r["expression"]), r["constraint_name"]))
    tables = []
    for name, own in cols.items():
        of = lambda kind, name=name: [k for k in keys.get(name, []) if k["kind"] == kind]
        fks = tuple(ForeignKey(tuple(k["columns"]), k["ref_table"], tuple(k["references"]), k["constraint_name"], k["on_delete"], k["on_update"], bool(k["deferrable"])) for k in of("f") if k["ref_table"] in cols)
        primary = next((tuple(k["columns"]) for k in of("p")), ())
        uniques = tuple(tuple(k["columns"]) for k in of("u"))
        indexes = tuple(Index(k["constraint_name"], tuple(k["columns"]), True) for k in of("i"))
        tables.append(with_check_values(Table(name, tuple(own), primary, fks, uniques, tuple(checks.get(name, ())), indexes)))
    return Schema.of(*tables, enums=labels)


def introspect(spark: SparkSession, url: str, schema: str = "public", allowed: bool = False, **options) -> Schema:
    """The schema of the database at a URL. MySQL's schema is the URL's database unless another one is named."""
    dialect = database_kind(url)
    if dialect == "sqlite":
        return sqlite_schema(url.removeprefix("sqlite:").removeprefix("//"))
    if dialect not in QUERIES:
        raise IntrospectionFailed(f"{dialect} sources have no catalog", hints=("read them with read_tables and table_from_frame",))
    guard(url, allowed)
    if dialect == "mysql" and schema == "public":
        found = re.search(r"://[^/]+/([\w$-]+)", url)
        schema = found[1] if found else schema
    link = url if url.startswith("jdbc:") else f"jdbc:{url}"
    read = lambda q: spark.read.format("jdbc").options(url=link, query=q, **options).load()
    try:
        got = {k: read(q) for k, q in catalog_sql(dialect, schema).items()}
        return schema_of_catalog(got["columns"], got["constraints"], got.get("enums"), dialect)
    except Exception as e:
        raise IntrospectionFailed(f"the catalog can't be read: {e}", hints=("is the driver's jar on the class path?",)) from e
