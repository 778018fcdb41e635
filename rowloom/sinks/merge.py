"""Row-level regeneration: new rows of a table are merged into what was written, and only files that change are replaced.

Old and new rows meet by key with a digest each, in one join of narrow rows, which says of each key whether it is the same,
changed, added or gone. A file that holds a changed row or one that is gone is replaced; its other rows are written
again with the changed and added ones, all others stay as they are. Files go in before the ones they replace go out, under
names of one mark, so a run that is cut off in between leaves rows twice, never none; the next one takes them out: of rows
with one key, one is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import files
from ..errors import OutputFailed
from ..scratch import drop, materialise


@dataclass(frozen=True)
class Merged:
    same: int = 0
    changed: int = 0
    added: int = 0
    gone: int = 0
    files_replaced: int = 0
    files_kept: int = 0

    @property
    def written(self) -> bool:
        return bool(self.changed or self.added or self.gone or self.files_replaced)


def digest(columns: list[str]) -> Column:
    """Two 64-bit hashes of a row's values and of which of them are null."""
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "n").otherwise("v") for c in columns])
    values = [F.col(f"`{c}`") for c in columns]
    return F.struct(F.xxhash64(nulls, *values).alias("a"), F.xxhash64(F.lit(1), *values, nulls).alias("b"))


def merge_rows(new: DataFrame, path: str, keys: list[str], form: str = "parquet") -> Merged:
    """Make the folder's rows those of new, by its primary key; new's columns are the table's. A folder that isn't there, or
    whose columns are others, is written anew."""
    spark = new.sparkSession
    if not keys:
        raise OutputFailed(f"{path}: rows without a primary key can't be merged", hints=("write it with another mode",))
    there = files.names(spark, path)
    old = spark.read.format(form).load(path) if there else None
    if old is None or old.schema.simpleString() != new.schema.simpleString():
        added = files.add(new, path, form)
        files.delete_files(spark, [f"{path}/{n}" for n in there])
        return Merged(added=spark.read.format(form).load(added).count() if added else 0, files_replaced=len(there))
    new = materialise(new, "merged")  # read twice, and it has to be the same
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    was = old.select(*keys, digest(new.columns).alias("__old"), F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))).alias("__file"))
    # Which of the rows that repeat a key stays doesn't matter: theirs are files that are replaced.
    was = was.groupBy(*keys).agg(F.min("__old").alias("__old"), F.count("*").alias("__times"), F.collect_set("__file").alias("__files"))
    now = new.select(*[F.col(k).alias(f"__new_{k}") for k in keys], digest(new.columns).alias("__new"))
    met = was.join(now, [F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in keys], "full_outer")
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "gone").when((F.col("__old") == F.col("__new")) & (F.col("__times") == 1), "same").otherwise("changed")
    met = materialise(met.select(*[F.coalesce(k, f"__new_{k}").alias(k) for k in keys], status.alias("status"), "__files"), "met")
    counts = {r["status"]: r["count"] for r in met.groupBy("status").count().collect()}
    # As many as there are files at most.
    touched = sorted(r[0] for r in met.where("status in ('changed', 'gone')").select(F.explode("__files")).distinct().collect())
    wanted = met.where((F.col("status") == "added") | (F.col("status") == "changed") | (F.col("status") == "same") & F.exists("__files", lambda f: f.isin(touched)))
    if touched or counts.get("added"):
        of = wanted.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
        files.add(new.join(of, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left_semi"), path, form)
        files.delete_files(spark, [f"{path}/{n}" for n in touched])
    drop(new, met)
    return Merged(counts.get("same", 0), counts.get("changed", 0), counts.get("added", 0), counts.get("gone", 0), len(touched), len(there) - len(touched))
