"""From column to value builder: constraint, name, stem, type - the first that knows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, rng
from ..functions.values import NAMED, Builder, boolean, code, decimal, digits, from_list, hex_digits, integer, ipv4, moment, null, pairs_of, sentence, uuid4, words
from ..schema import Check, Column, Kind, Table
from . import vocabulary

EXACT, TIMES_BY_NAME = vocabulary.exact(), vocabulary.times()
SUFFIXES, PREFIXES = vocabulary.ends(), vocabulary.beginnings()
#: Domain and weight by stem.
STEMS: dict[str, tuple[str, float]] = {names.stem(w): (domain, weight) for domain, (weight, words_) in reversed(vocabulary.STEMS.items()) for w in words_}
NOISE = {names.stem(x) for x in vocabulary.NOISE}
BY_DOMAIN: dict[str, dict[str, str]] = {
    "person": {"text": "person.full_name", "number": "person.age"}, "contact": {"text": "contact.email"}, "location": {"text": "location.city", "number": "location.latitude"}, "finance": {"text": "finance.currency", "number": "finance.amount"},
    "commerce": {"text": "commerce.product", "number": "commerce.quantity"}, "identifier": {"text": "identifier.code"}, "time": {"time": "time.recent", "number": "time.year"}, "text": {"text": "text.sentence"}, "internet": {"text": "internet.slug"}, "boolean": {"bool": "boolean.coin"},
    "medical": {"text": "text.words", "number": "commerce.quantity"}, "transport": {"text": "identifier.code", "number": "commerce.quantity"}, "education": {"text": "text.words", "number": "commerce.rating"}, "government": {"text": "identifier.serial"}, "legal": {"text": "text.sentence"},
}
NUMBERS = {Kind.SMALLINT, Kind.INTEGER, Kind.BIGINT, Kind.REAL, Kind.DOUBLE, Kind.DECIMAL}
TEXTS = {Kind.TEXT, Kind.VARCHAR, Kind.CHAR}
TIMES = {Kind.DATE, Kind.TIMESTAMP, Kind.TIMESTAMPTZ, Kind.TIME}


@dataclass(frozen=True)
class Mapping:
    column: str
    builder: Builder
    source: str  # enum, skip, shortcut, name, suffix, prefix, stem, check, type
    generator: str = ""
    confidence: str = "high"


def group_of(kind: Kind) -> str:
    return "number" if kind in NUMBERS else "text" if kind in TEXTS else "time" if kind in TIMES else "bool" if kind is Kind.BOOLEAN else "other"


#: What a builder makes; a name binds only to columns that can hold it.
def makes(generator: str) -> str:
    if generator in ("boolean.coin",):
        return "bool"
    if generator in ("time.year", "time.month", "time.day", "time.hour", "time.minute", "person.age", "commerce.quantity", "commerce.rating", "commerce.weight", "commerce.price", "finance.amount", "finance.rate", "location.latitude", "location.longitude"):
        return "number"
    if generator.startswith("time.") or generator == "person.birth_date":
        return "time"
    return "text"


def fits(generator: str, c: Column) -> bool:
    made, held = makes(generator), group_of(c.kind)
    return made == held or (held == "text" and made != "bool") or (c.kind is Kind.UUID and generator == "identifier.uuid") or (c.kind is Kind.INET and generator.startswith("internet.ip"))


def fallback(c: Column) -> Builder:
    match c.kind:
        case Kind.TEXT:
            return sentence()
        case Kind.VARCHAR:
            return words(3)
        case Kind.CHAR:
            return lambda x: F.substring(F.translate(F.concat(x.hex(0), x.hex(1)), "0123456789", "ghijklmnop"), 1, min(64, c.max_length or 1))
        case Kind.SMALLINT:
            return integer(0, 32767)
        case Kind.INTEGER:
            return integer(1, 100000)
        case Kind.BIGINT:
            return integer(1, 1000000)
        case Kind.REAL:
            return decimal(0, 1000, 2)
        case Kind.DOUBLE:
            return decimal(0, 1000000, 4)
        case Kind.DECIMAL:
            p, s = c.precision or 10, 2 if c.scale is None else c.scale
            return decimal(0, min(10 ** (p - s) - 1, 999999), s)
        case Kind.BOOLEAN:
            return boolean
        case Kind.DATE:
            return lambda x: moment(-2 * 365 * 86400, 0)(x).cast("date")
        case Kind.TIMESTAMP | Kind.TIMESTAMPTZ:
            return moment(-2 * 365 * 86400, 0)
        case Kind.TIME:
            return lambda x: F.concat_ws(":", *[F.lpad(rng.between(x.u(i), 0, m).cast("string"), 2, "0") for i, m in enumerate((23, 59, 59))])
        case Kind.INTERVAL:
            return lambda x: F.expr("INTERVAL '1' DAY")
        case Kind.JSON | Kind.JSONB:
            return lambda x: F.lit("{}")
        case Kind.UUID:
            return uuid4
        case Kind.BYTEA:
            return lambda x: F.unhex(hex_digits(32)(x))
        case Kind.INET:
            return ipv4
        case Kind.CIDR:
            return lambda x: F.concat(ipv4(x), F.lit("/24"))
        case Kind.MACADDR:
            return pairs_of(6, ":")
        case Kind.ARRAY:
            return lambda x: F.array().cast("array<string>")
        case Kind.POINT:
            return lambda x: F.concat(F.lit("("), decimal(-90, 90, 6)(x).cast("string"), F.lit(","), decimal(-180, 180, 6)(x).cast("string"), F.lit(")"))
        case Kind.LINE:
            return lambda x: F.lit("{0,0,0}")
        case Kind.VECTOR:
            return lambda x: F.array(*[(x.u(i) * 2 - 1).cast("float") for i in range(c.max_length or 3)])
    return null


def stem_scores(name: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for t in names.tokens(name):
        s = names.stem(t)
        if s not in NOISE and s in STEMS:
            d, w = STEMS[s]
            out[d] = out.get(d, 0.0) + w
    return out


def score_columns(columns: DataFrame) -> DataFrame:
    """For columns (table, column): domain, score and rank of each domain that words of the name hint at, the first of
    equals by its name. Words are told apart once, stemmed, and joined with the table of stems (some hundred rows)."""
    spark = columns.sparkSession
    stems = spark.createDataFrame([(s, d, w) for s, (d, w) in STEMS.items() if s not in NOISE], "stem string, domain string, weight double")
    words_ = columns.select("table", "column", F.explode(names.tokens_column(F.col("column"))).alias("word"))

    def run(batches):
        for b in batches:
            yield b.assign(stem=[names.stem(w) for w in b["word"]])

    stemmed = words_.select("word").distinct().mapInPandas(run, "word string, stem string")
    found = words_.join(stemmed, "word").join(F.broadcast(stems), "stem").groupBy("table", "column", "domain").agg(F.round(F.sum("weight"), 6).alias("score"))
    order = Window.partitionBy("table", "column").orderBy(F.desc("score"), "domain")
    return found.withColumn("rank", F.row_number().over(order).cast("long"))


def check_values(table: Table, column: Column) -> tuple[str, ...]:
    import re

    return next((c.values for c in table.checks if c.values and re.search(rf"\b{re.escape(column.name)}\b", c.expression)), ())


def map_column(c: Column, table: Table) -> Mapping:
    if c.values:
        return Mapping(c.name, from_list([v[: c.max_length] for v in c.values]), "enum")
    if c.auto_increment or c.generated:
        return Mapping(c.name, null, "skip")
    if c.kind in (Kind.JSON, Kind.JSONB, Kind.ARRAY):
        return Mapping(c.name, fallback(c), "shortcut")
    raw, name = c.name.lower(), names.normalise(c.name, table.name)
    for n in dict.fromkeys((raw, name)):
        for known in (EXACT, TIMES_BY_NAME) if c.kind not in TIMES else (TIMES_BY_NAME, EXACT):
            if (g := known.get(vocabulary.squeezed(n))) and fits(g, c):
                return Mapping(c.name, NAMED[g], "name", g)
    for n in dict.fromkeys((raw, name)):
        for s, g in SUFFIXES:
            if n.endswith(s) and len(n) > len(s) and fits(g, c):
                return Mapping(c.name, NAMED[g], "suffix", g, "medium")
        for p, g in PREFIXES:
            if n.startswith(p) and len(n) > len(p) and fits(g, c):
                return Mapping(c.name, NAMED[g], "prefix", g, "medium")
    values = check_values(table, c)
    if values:
        return Mapping(c.name, from_list([v[: c.max_length] for v in values]), "check")
    scores = stem_scores(c.name)
    if scores:
        best = max(scores, key=lambda d: scores[d])
        g = BY_DOMAIN[best].get(group_of(c.kind))
        if scores[best] >= 0.5 and g:
            return Mapping(c.name, NAMED[g], "stem", g, "low")
    return Mapping(c.name, fallback(c), "type", confidence="low")


def map_table(table: Table) -> dict[str, Mapping]:
    return {c.name: map_column(c, table) for c in table.columns}


def resolve_generator(name: str) -> Builder:
    from ..errors import UnknownGenerator

    if name not in NAMED:
        near = names.suggest(name, list(NAMED), 3)
        raise UnknownGenerator(f"no generator '{name}'", hints=(f"did you mean '{near}'?",) if near else ())
    return NAMED[name]


__all__ = ["Check", "Mapping", "map_column", "map_table", "resolve_generator", "stem_scores", "digits", "code"]
