"""Schema changes: hashes of tables, comparison of states, and what to generate again."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import Schema, Table


def describe(t: Table) -> str:
    cols = sorted(f"{c.name}:{c.kind}:{int(c.nullable)}:{int(c.auto_increment)}:{int(c.generated)}:{c.max_length}:{c.precision}:{c.scale}:{'/'.join(c.values)}" for c in t.columns)
    fks = sorted(f"{','.join(f.columns)}>{f.table}({','.join(f.references)})" for f in t.foreign_keys)
    return ";".join([*cols, "pk " + ",".join(t.primary_key), *fks, *sorted("u " + ",".join(u) for u in t.uniques)])


def hashes(schema: Schema) -> dict[str, str]:
    return {k: hashlib.sha256(describe(t).encode()).hexdigest() for k, t in schema.tables.items()}


def hash_columns(columns: DataFrame, by: str = "table") -> DataFrame:
    """Hashes from a table of columns (table, column, kind): many schemas at once."""
    parts = F.sort_array(F.collect_list(F.concat_ws(":", "column", "kind")))
    return columns.groupBy(by).agg(F.sha2(F.array_join(parts, ";"), 256).alias("hash"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, change) of two tables (table, hash)."""
    a, b = old.select("table", F.col("hash").alias("h_old")), new.select("table", F.col("hash").alias("h_new"))
    change = F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "removed").when(F.col("h_old") == F.col("h_new"), "unchanged").otherwise("changed")
    return a.join(b, "table", "full_outer").select("table", change.alias("change"))


def diff(old: dict[str, str], new: dict[str, str]) -> dict[str, list[str]]:
    return {
        "added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys()),
        "changed": sorted(k for k in new.keys() & old.keys() if new[k] != old[k]), "unchanged": sorted(k for k in new.keys() & old.keys() if new[k] == old[k]),
    }


def save_state(path: str, schema: Schema) -> None:
    with open(path, "w") as f:
        json.dump({"version": 1, "tables": hashes(schema)}, f, indent=1, sort_keys=True)


def load_state(path: str) -> dict[str, str] | None:
    try:
        with open(path) as f:
            tables = json.load(f)["tables"]
        return tables if isinstance(tables, dict) else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def to_regenerate(state: dict[str, str] | None, schema: Schema) -> list[str] | None:
    """Added and changed tables; None (all) without a state."""
    if state is None:
        return None
    d = diff(state, hashes(schema))
    return sorted([*d["added"], *d["changed"]])


def hashes_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    return spark.createDataFrame(sorted(hashes(schema).items()), "table string, hash string")
