"""Tables as lazy DataFrames: keys, references, values, NULLs, uniqueness, deferred references.

A row is a function of its number, so a table is ``spark.range(n)`` with expressions, plus one equi-join
for each foreign key whose parent keys are not themselves a function of their ordinal. Nothing is
collected but counts. The same expressions work over a stream of row numbers (``Generator.table`` with rows).

Keys of several columns are unique by construction where each column has a known domain (references,
enumerations, booleans): row numbers are permuted over the product of the domains. Where one of them is
free (texts, numbers, days, moments), equal keys are told apart by a suffix to it. Keys that existing rows
have are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyReferencePool, GenerationFailed
from ..functions import rng
from ..functions.corpora import known
from ..functions.values import Ctx
from ..schema import Column, ForeignKey, Kind, Schema, Table, ancestors
from ..scratch import materialise
from . import coherence, predicates, unique
from .cardinality import Cardinality, allocate, expand
from .existing import Existing, read_existing
from .mapping import NUMBERS, Mapping, map_table
from .plan import InsertPlan, insert_plan
from .prefix import ordinals

ROOT_SHARE = 0.15


@dataclass
class Config:
    seed: int = 42
    rows: int = 50
    rows_of: dict[str, int] = field(default_factory=dict)
    null_rate: float = 0.1
    ref: int = 1735689600
    cardinality: dict[str, dict[str, Cardinality]] = field(default_factory=dict)
    coherent: bool = True
    overrides: dict[str, dict[str, dict]] = field(default_factory=dict)
    text_pools: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    builders: Callable[[Column, Table], Callable | None] | None = None  # plugins
    partitions: int | None = None
    locale: str = "en"

    def __post_init__(self):
        self.locale = known(self.locale)

    def count(self, table: str) -> int:
        """Rows of a table; what isn't a whole number from 0 on becomes 1."""
        n = self.rows_of.get(table, self.rows_of.get(table.rsplit(".", 1)[-1], self.rows))
        return n if isinstance(n, int) and not isinstance(n, bool) and n >= 0 else 1


@dataclass
class Pool:
    """Parents' keys by ordinal: a table (ord, keys), or base + ord where keys are consecutive."""

    size: int
    frame: DataFrame | None = None
    base: int | None = None


@dataclass
class Domain:
    """Columns of a unique key that take one of ``size`` values together: a reference, or a list."""

    columns: tuple[str, ...]
    size: int
    key: ForeignKey | None = None
    pool: Pool | None = None
    values: tuple = ()


@dataclass
class Generated:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    updates: dict[str, list[DataFrame]] = field(default_factory=dict)
    plan: InsertPlan | None = None
    counts: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def parent_ordinal(seed: int, table: str, fk: tuple[str, ...], row: SparkColumn, size: int) -> SparkColumn:
    return F.floor(rng.uniform(seed, table, "+".join(fk), row) * F.lit(size)).cast("long")


def tree_parent(seed: int, table: str, column: str, row: SparkColumn, rows: int) -> SparkColumn:
    """Ordinal of a row's parent in its own table: none for the first 15 % and row 0, else an earlier row."""
    roots = int(ROOT_SHARE * rows)
    return F.when((row >= roots) & (row > 0), F.floor(rng.uniform(seed, table, column, row) * row).cast("long"))


def insertable(table: Table) -> list[str]:
    return [c.name for c in table.columns if not c.generated and not (c.auto_increment and c.name not in table.primary_key)]


class Generator:
    def __init__(self, spark: SparkSession, schema: Schema, config: Config | None = None, existing: dict[str, DataFrame] | None = None):
        self.spark, self.schema, self.config = spark, schema, config or Config()
        self.existing = {schema.resolve(k) or k: v for k, v in (existing or {}).items()}
        self.state: dict[str, Existing] = {}
        self.pools: dict[tuple, Pool] = {}
        self.plan = insert_plan(schema)
        self.out = Generated(plan=self.plan, warnings=list(self.plan.warnings))

    def known(self, key: str) -> Existing:
        if key not in self.state:
            self.state[key] = read_existing(self.schema.tables[key], self.existing.get(key))
            self.out.warnings += self.state[key].warnings
        return self.state[key]

    def pool(self, key: str, columns: tuple[str, ...]) -> Pool:
        """Existing and generated parents, over the referenced columns; looked up once for each state of the parent."""
        at = (key, columns, self.out.counts.get(key))
        if at not in self.pools:
            self.pools[at] = self.new_pool(key, columns)
        return self.pools[at]

    def new_pool(self, key: str, columns: tuple[str, ...]) -> Pool:
        table, old = self.schema.tables[key], self.known(key)
        n = self.out.counts.get(key, 0)
        auto = len(columns) == 1 and table.column(columns[0]).auto_increment and columns == table.primary_key
        if auto and not old.rows:
            return Pool(n, base=1)
        frames = [f.select(*columns) for f in (old.frame, self.out.tables.get(key)) if f is not None and set(columns) <= set(f.columns)]
        if not frames:
            return Pool(0)
        every = frames[0]
        for f in frames[1:]:
            every = every.unionAll(f)
        # Rows without a key are no parents, and a key counts once, also where the referenced columns aren't unique.
        every = every.where(" and ".join(f"`{c}` is not null" for c in columns))
        if columns != table.primary_key and columns not in table.uniques:
            every = every.distinct()
        if len(columns) == 1 and columns == table.primary_key and old.rows and columns[0] in old.next_key:
            # Keys that are dense in fact need no join; one aggregate says so.
            low = old.frame.agg(F.min(columns[0]).alias("lo"), F.countDistinct(columns[0]).alias("d")).first()
            top = old.next_key[columns[0]]
            if low["d"] == old.rows == top - low["lo"] and (auto or not n):
                return Pool(old.rows + n, base=low["lo"])
        ranked = ordinals(every, list(columns))
        return Pool(ranked.count(), frame=ranked.select("ord", *columns))

    def attach(self, df: DataFrame, pool: Pool, ordinal: SparkColumn, fk: ForeignKey) -> DataFrame:
        """df with fk's columns from the pool at ordinal. Parents are dealt by ordinal; many children of one
        parent (zipf) are a skewed join, which adaptive execution splits."""
        if pool.base is not None:
            return df.withColumn(fk.columns[0], ordinal + F.lit(pool.base))
        parents = pool.frame.select(F.col("ord").alias("__ord_p"), *[F.col(r).alias(f"__p_{c}") for c, r in zip(fk.columns, fk.references, strict=True)])
        df = df.withColumn("__ord_c", ordinal).join(parents, F.col("__ord_c") == F.col("__ord_p"), "left")
        for c in fk.columns:
            df = df.withColumn(c, F.col(f"__p_{c}"))
        return df.drop("__ord_c", "__ord_p", *[f"__p_{c}" for c in fk.columns])

    def value(self, c: Column, table: Table, mapping: Mapping, row: SparkColumn) -> SparkColumn:
        cfg, key = self.config, table.full_name
        ctx = Ctx(cfg.seed, key, c.name, row, cfg.ref, c.max_length, cfg.locale)
        over = cfg.overrides.get(key, cfg.overrides.get(table.name, {})).get(c.name, {})
        if "values" in over:
            values = over["values"]
            if "weights" in over:
                v = rng.weighted(ctx.u(), values, over["weights"])
            elif over.get("cyclic"):
                v = rng.cyclic(row, values)
            else:
                v = rng.pick(ctx.u(), values)
        elif "distribution" in over:
            low, high = over.get("min", 0), over.get("max", 1)
            v = F.lit(low) + rng.share(over["distribution"], cfg.seed, key, c.name, row, cfg.count(key)) * F.lit(high - low)
        else:
            plugged = cfg.builders(c, table) if cfg.builders else None
            v = (over.get("builder") or plugged or mapping.builder)(ctx)
        v = v.cast(c.spark_type())
        if c.max_length and c.kind in (Kind.VARCHAR, Kind.CHAR, Kind.TEXT):
            v = F.rtrim(F.substring(v, 1, c.max_length))
        return v

    def with_nulls(self, v: SparkColumn, c: Column, table: Table, row: SparkColumn) -> SparkColumn:
        over = self.config.overrides.get(table.full_name, self.config.overrides.get(table.name, {})).get(c.name, {})
        rate = over.get("nullable", self.config.null_rate if c.nullable else 0.0)
        if not c.nullable or rate <= 0 or c.name in table.primary_key:
            return v
        return F.when(rng.uniform(self.config.seed, table.full_name, f"{c.name}?", row) >= F.lit(float(rate)), v)

    def table(self, key: str, rows: DataFrame | None = None) -> DataFrame:
        """One table. Column order of precedence: generated (left out), auto-increment, deferred reference,
        unique key of known domains, reference, pair or group, text pool, value; then NULLs, then uniqueness.

        rows: a frame with ``__row``, which may be a stream; other columns of it stay. Without, the configured number."""
        cfg, t, n = self.config, self.schema.tables[key], self.config.count(key)
        old, row = self.known(key), F.col("__row")
        df = rows if rows is not None else self.spark.range(0, n, 1, cfg.partitions).select(F.col("id").alias("__row")) if cfg.partitions else self.spark.range(n).select(F.col("id").alias("__row"))
        later = {fk for e in self.plan.deferred if e.child == key for fk in [e.key]} | {e.key for e in self.plan.self_references.get(key, [])}
        done: set[str] = set()
        if n:
            df, done = self.place_keys(df, t, later, n)
        for fk in t.foreign_keys:
            parent = self.schema.resolve(fk.table)
            if fk in later or parent is None or set(fk.columns) <= done:
                continue
            pool = self.pool(parent, fk.references)
            if not pool.size or not n:
                if n and not all(t.column(c).nullable for c in fk.columns):
                    raise EmptyReferencePool(f"{key}.{','.join(fk.columns)} needs rows of {parent}", hints=(f"generate {parent} first",))
                for c in fk.columns:
                    df = df.withColumn(c, F.lit(None).cast(t.column(c).spark_type()))
            else:
                spec = cfg.cardinality.get(key, cfg.cardinality.get(t.name, {})).get(fk.columns[0]) if len(fk.columns) == 1 else None
                if spec:
                    df = self.by_cardinality(df, key, fk, pool, spec, n)
                else:
                    df = self.attach(df, pool, parent_ordinal(cfg.seed, key, fk.columns, row, pool.size), fk)
            done |= set(fk.columns)
        group_of = {}
        if cfg.coherent:
            overridden = cfg.overrides.get(key, cfg.overrides.get(t.name, {}))
            for g in coherence.detect(t):
                if not any(c in overridden or t.column(c).values or c in done for _, c in g.columns):
                    for c, v in coherence.columns_of(g, Ctx(cfg.seed, key, "", row, cfg.ref, locale=cfg.locale)).items():
                        group_of.setdefault(c, v)
        mappings, exprs, values, uniques = map_table(t), {}, {}, []
        for c in t.columns:
            if c.generated or c.name in done or (c.auto_increment and c.name not in t.primary_key):
                continue
            deferred = next((fk for fk in later if c.name in fk.columns), None)
            if c.auto_increment:
                exprs[c.name] = (row + F.lit(old.next_key.get(c.name, 1))).cast(c.spark_type())
            elif deferred:
                exprs[c.name] = F.lit(None).cast(c.spark_type())
            elif (key, c.name) in cfg.text_pools:
                continue
            else:
                values[c.name] = group_of[c.name].cast(c.spark_type()) if c.name in group_of else self.value(c, t, mappings[c.name], row)
                if self.alone(t, c.name) or cfg.overrides.get(key, {}).get(c.name, {}).get("unique"):
                    uniques.append(((c.name,), c))
        # What CHECK constraints say of numbers and times holds before NULLs, which satisfy any of them.
        given = {c.name for c in t.columns if c.values or c.name in cfg.overrides.get(key, cfg.overrides.get(t.name, {}))}
        values = predicates.apply(values, t, lambda name: Ctx(cfg.seed, key, name, row, cfg.ref), given)
        exprs |= {c: self.with_nulls(v, t.column(c), t, row) for c, v in values.items()}
        df = df.select("*", *[exprs[c.name].alias(c.name) for c in t.columns if c.name in exprs])
        for (k, name), texts in cfg.text_pools.items():
            if k == key:
                df = text_pool_fill(df, name, texts, "__row")
                if self.alone(t, name):
                    uniques.append(((name,), t.column(name)))
        single = {c.name for _, c in uniques}
        for columns in composite_keys(t):
            free = next((c for c in map(t.column, columns) if c.name in exprs and not c.auto_increment and bump_kind(c, "")), None)
            if free is not None and not set(columns) <= done and not any(self.alone(t, c) or c in single for c in columns):
                uniques.append((columns, free))
        for columns, c in uniques:
            kind = bump_kind(c, mappings[c.name].generator)
            if kind is None:
                continue
            if df.isStreaming:
                df = df.withColumn(c.name, F.when(F.col(c.name).isNotNull(), unique.by_row(F.col(c.name), row, kind, c.max_length).cast(c.spark_type())))
                continue
            by = tuple(x for x in columns if x != c.name)
            taken = old.frame.select(*by, c.name) if old.frame is not None and set(columns) <= set(old.frame.columns) else None
            df = unique.resolve(df, c.name, "__row", kind, taken, c.max_length, by)
        return df

    def alone(self, t: Table, name: str) -> bool:
        return (name,) in t.uniques or t.primary_key == (name,) or any(i.unique and i.columns == (name,) for i in t.indexes)

    def domain(self, t: Table, column: str, key: tuple[str, ...], later) -> Domain | None:
        """What a column of a unique key can be, where that is known; None for a free column."""
        c, over = t.column(column), self.config.overrides.get(t.full_name, self.config.overrides.get(t.name, {})).get(column, {})
        for fk in t.foreign_keys:
            parent = self.schema.resolve(fk.table)
            if column in fk.columns and parent is not None and fk not in later and set(fk.columns) <= set(key):
                pool = self.pool(parent, fk.references)
                return Domain(fk.columns, pool.size, fk, pool)
        values = tuple(over["values"]) if "values" in over else c.values if not over else ()
        if values or (c.kind is Kind.BOOLEAN and not over):
            values = tuple(dict.fromkeys(v[: c.max_length] if isinstance(v, str) else v for v in values)) or (False, True)
            return Domain((column,), len(values), values=values)
        return None

    def place_keys(self, df: DataFrame, t: Table, later, n: int) -> tuple[DataFrame, set[str]]:
        """Columns of unique keys whose domains are all known (one-to-one references too): tuples by permuted
        row numbers, as many columns as make n of them distinct, the others drawn. A key that shares columns with
        one that is placed gets its own columns by numbering the rows in the order of the shared ones: equal shared
        values stand next to each other, and neighbours get different tuples. Rows whose key exists already give
        way to later ones."""
        done: set[str] = set()
        placed: list[tuple[tuple[str, ...], list[Domain]]] = []
        joined: list[tuple[tuple[str, ...], list[Domain], list[Domain]]] = []
        old = self.known(t.full_name)
        domain_of: dict[tuple[str, ...], Domain] = {}
        for columns in [k for k in ((t.primary_key), *t.uniques, *(i.columns for i in t.indexes if i.unique)) if k]:
            if any(t.column(c).auto_increment or t.column(c).generated or t.column(c).kind is Kind.UUID and self.domain(t, c, columns, later) is None for c in columns):
                continue
            if len(columns) > 1 and any(self.alone(t, c) for c in columns):
                continue
            domains = {d.columns: d for d in (self.domain(t, c, columns, later) for c in columns) if d is not None}
            if {c for d in domains.values() for c in d.columns} != set(columns) or (len(columns) == 1 and not next(iter(domains.values())).key and t.column(columns[0]).kind not in (Kind.ENUM, Kind.BOOLEAN)):
                continue
            card = self.config.cardinality.get(t.full_name, self.config.cardinality.get(t.name, {}))
            if any(not d.size for d in domains.values()) or (len(columns) == 1 and columns[0] in card):
                continue
            listed = sorted(domains.values(), key=lambda d: (-d.size, d.columns))
            shared = [domain_of[d.columns] for d in listed if d.columns in domain_of]
            new = [d for d in listed if not set(d.columns) & done]
            if len(shared) + len(new) < len(listed):
                raise GenerationFailed(f"{t.full_name}: the unique keys over {', '.join(columns)} share columns of a composite reference", hints=("leave one of them out",))
            if shared:
                joined.append((columns, shared, new))
            else:
                placed.append((columns, listed))
            done |= set(columns)
            domain_of |= {d.columns: d for d in new}
        if not placed:
            return df, done
        keys = [columns for columns, *_ in (*placed, *joined)]
        met = [(columns, old.frame.select(*columns).where(" and ".join(f"`{c}` is not null" for c in columns)).distinct()) for columns in keys if old.rows and old.frame is not None and set(columns) <= set(old.frame.columns)]
        spare = sum(f.count() for _, f in met)
        if (spare or joined) and df.isStreaming:
            raise GenerationFailed(f"a stream of {t.full_name} can't go around its existing keys, or place keys that share columns")
        for columns, size, have in [(c, math.prod(d.size for d in ds), " x ".join(str(d.size) for d in ds)) for c, ds in placed] + [(c, math.prod(d.size for d in (*a, *b)), " x ".join(str(d.size) for d in (*a, *b))) for c, a, b in joined]:
            if n + spare > size:
                raise GenerationFailed(f"{t.full_name} can't have {n} more distinct {', '.join(columns)}: there are {size} ({have}), {spare} may be taken")
        if spare:
            df = self.spark.range(n + spare).select(F.col("id").alias("__row"))
        common = {d.columns for _, shared, _ in joined for d in shared}
        for _, domains in placed:
            df = self.place(df, t, domains, n + spare, common)
        for columns, shared, new in joined:
            df = self.place_beside(df, t, columns, shared, new)
        if spare:
            for columns, frame in met:
                taken = frame.select(*[F.col(c).alias(f"__old_{c}") for c in columns])
                df = df.join(taken, [F.col(c) == F.col(f"__old_{c}") for c in columns], "left_anti")
            df = ordinals(df, ["__row"], "__at").where(F.col("__at") < n).withColumn("__row", F.col("__at")).drop("__at")
        return df, done

    def place(self, df: DataFrame, t: Table, domains: list[Domain], n: int, common: set[tuple[str, ...]] = frozenset()) -> DataFrame:
        """common: domains that other keys have too; their values are dealt in turn, so that each is met equally often."""
        row, seed = F.col("__row"), self.config.seed
        shared = [d for d in domains if d.columns in common]
        if shared:
            rest = [d for d in domains if d.columns not in common]
            at = unique.dealt_ordinals(row, [d.size for d in (*rest, *shared)], seed)
            return self.fill(df, t, zip((*rest, *shared), at, strict=True))
        first, size = 0, 1
        while size < n and first < len(domains):
            size *= domains[first].size
            first += 1
        first = max(first, 1)
        at = unique.tuple_ordinals(row, [d.size for d in domains[:first]], seed)
        at += [F.floor(rng.uniform(seed, t.full_name, "+".join(d.columns), row) * F.lit(d.size)).cast("long") for d in domains[first:]]
        return self.fill(df, t, zip(domains, at, strict=True))

    def fill(self, df: DataFrame, t: Table, ordinals_of) -> DataFrame:
        """Columns of domains by the ordinals of their values."""
        for d, ordinal in ordinals_of:
            if d.key is not None:
                df = self.attach(df, d.pool, ordinal, d.key)
            else:
                c = t.column(d.columns[0])
                df = df.withColumn(c.name, F.element_at(F.array(*[F.lit(v) for v in d.values]), (ordinal + 1).cast("int")).cast(c.spark_type()))
        return df

    def place_beside(self, df: DataFrame, t: Table, columns: tuple[str, ...], shared: list[Domain], new: list[Domain]) -> DataFrame:
        """The key's new columns for rows whose shared ones stand. Rows of equal shared values are neighbours in their
        order, and no more than there are new tuples: checked by one count, as nothing else could make the key unique."""
        by = [c for d in shared for c in d.columns]
        size = math.prod(d.size for d in new)
        df = materialise(df, "beside")
        most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if most > size:
            why = f"{most} rows share {', '.join(by)}, for which {', '.join(c for d in new for c in d.columns) or 'no other column'} has {size} values"
            raise GenerationFailed(f"{t.full_name} can't have distinct {', '.join(columns)} beside its other keys: {why}", hints=("fewer rows, or more values",))
        if not new:
            return df
        numbered = ordinals(df, [*by, "__row"], "__beside")
        at = unique.digits_of(F.col("__beside"), [d.size for d in new])
        return self.fill(numbered, t, zip(new, at, strict=True)).drop("__beside")

    def by_cardinality(self, df: DataFrame, key: str, fk: ForeignKey, pool: Pool, spec: Cardinality, n: int) -> DataFrame:
        cfg = self.config
        parents = pool.frame if pool.frame is not None else self.spark.range(pool.size).select(F.col("id").alias("ord"), (F.col("id") + pool.base).alias(fk.references[0]))
        parents = parents.withColumn("share", rng.share(spec.distribution, cfg.seed, key, fk.columns[0] + "#", F.col("ord"), pool.size, **dict(spec.options)))
        each = expand(allocate(parents, n, spec), cfg.seed, key, fk.columns[0], [fk.references[0]]).select("child_ord", F.col(fk.references[0]).alias(fk.columns[0]))
        return df.join(each, F.col("__row") == F.col("child_ord"), "left").drop("child_ord")

    def fill_self(self, key: str, df: DataFrame) -> DataFrame:
        t, n = self.schema.tables[key], self.config.count(key)
        for e in self.plan.self_references.get(key, []):
            at = tree_parent(self.config.seed, key, e.key.columns[0], F.col("__row"), n)
            if e.key.references == t.primary_key and len(t.primary_key) == 1 and t.column(t.primary_key[0]).auto_increment:
                own = Pool(n, base=self.known(key).next_key.get(t.primary_key[0], 1))  # keys are arithmetic: no join
            else:
                own = Pool(n, frame=df.select(F.col("__row").alias("ord"), *e.key.references))
            df = self.attach(df.drop(*e.key.columns), own, at, e.key)
            keep = [c for c in t.primary_key if c in df.columns]
            if keep and not df.isStreaming:
                self.out.updates.setdefault(key, []).append(df.where(F.col(e.key.columns[0]).isNotNull()).select(*keep, *e.key.columns))
        return df

    def run(self, only: list[str] | None = None, unchanged: bool = False) -> Generated:
        """Tables in insert order. only: these tables alone; with unchanged, tables that they reference and that
        no existing rows stand for are taken to hold what the same configuration makes, and aren't put out."""
        wanted = set(self.plan.ordered if only is None else only)
        silent = {k for k in ancestors(self.schema, wanted) - wanted if self.existing.get(k) is None} if unchanged else set()
        for key in self.plan.ordered:
            if key not in wanted | silent:
                continue
            df = self.fill_self(key, self.table(key))
            self.out.counts[key] = self.config.count(key)
            self.out.tables[key] = df
        for e in self.plan.deferred:
            if e.child in wanted and e.child in self.out.tables:
                pool = self.pool(e.parent, e.key.references)
                if pool.size:
                    df = self.out.tables[e.child]
                    df = self.attach(df.drop(*e.key.columns), pool, parent_ordinal(self.config.seed, e.child, e.key.columns, F.col("__row"), pool.size), e.key)
                    self.out.tables[e.child] = df
                    keep = list(self.schema.tables[e.child].primary_key)
                    if keep:
                        self.out.updates.setdefault(e.child, []).append(df.select(*keep, *e.key.columns))
        for key in silent:
            self.out.tables.pop(key, None)
            self.out.counts.pop(key, None)
            self.out.updates.pop(key, None)
        for key, df in self.out.tables.items():
            t = self.schema.tables[key]
            self.out.tables[key] = df.select(*[F.col(c).cast(t.column(c).spark_type()).alias(c) for c in insertable(t)])
        return self.out


def composite_keys(t: Table) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(k for k in (t.primary_key, *t.uniques, *(i.columns for i in t.indexes if i.unique)) if len(k) > 1))


def bump_kind(c: Column, generator: str) -> str | None:
    """How equal values of a column can be told apart; None where they can't."""
    if c.kind in NUMBERS:
        return "number"
    if c.kind in (Kind.TEXT, Kind.VARCHAR, Kind.CHAR):
        return "email" if generator == "contact.email" else "text"
    return {Kind.DATE: "date", Kind.TIMESTAMP: "moment", Kind.TIMESTAMPTZ: "moment"}.get(c.kind)


def text_pool_fill(df: DataFrame, column: str, texts: DataFrame, row: str) -> DataFrame:
    """Texts of a pool in turn: row i gets text i mod pool size. texts: one string column."""
    pool = ordinals(texts.select(F.col(texts.columns[0]).alias("__text")).where("__text is not null"), ["__text"], "__at")
    n = pool.count()
    if not n:
        return df.withColumn(column, F.lit(None).cast("string"))
    return df.withColumn("__want", F.pmod(F.col(row), F.lit(n))).join(pool, F.col("__want") == F.col("__at"), "left").withColumn(column, F.col("__text")).drop("__want", "__at", "__text")


def generate(spark: SparkSession, schema: Schema, config: Config | None = None, existing: dict[str, DataFrame] | None = None, only: list[str] | None = None, unchanged: bool = False) -> Generated:
    return Generator(spark, schema, config, existing).run(only, unchanged)
