"""Text functions on names: as Columns where data may be large, as Python for schema names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemmer import stem


def snake_case(name: str) -> str:
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


def singular(word: str) -> str:
    """Singular of a plural noun, by the common endings."""
    fixed = {"people": "person", "children": "child", "men": "man", "women": "woman", "mice": "mouse", "data": "data", "series": "series", "status": "status", "news": "news", "address": "address"}
    if word in fixed:
        return fixed[word]
    for end, new in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("oes", "o"), ("ives", "ive"), ("ves", "f")):
        if word.endswith(end) and len(word) > len(end) + 1:
            return word[: -len(end)] + new
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 2 else word


def normalise(column: str, table: str = "") -> str:
    """Lower case with single underscores, without the table's name in front or filler words behind."""
    name = re.sub(r"_+", "_", column.lower().replace("-", "_")).strip("_")
    table = table.lower().rsplit(".", 1)[-1]
    for prefix in dict.fromkeys((table, singular(table))) if len(table) > 2 else ():
        if name.startswith(prefix + "_") and len(name) > len(prefix) + 1:
            name = name[len(prefix) + 1 :]
            break
    return re.sub(r"_(?:col|field|val|value)$", "", name)


def normalise_column(c: Column) -> Column:
    """normalise() without a table, over data."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "-", "_"), "_+", "_")
    return F.regexp_replace(F.regexp_replace(c, "^_|_$", ""), "_(col|field|val|value)$", "")


def tokens_column(c: Column) -> Column:
    """tokens() over data."""
    c = F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(c), r"[_\-\s]+"), lambda t: t != "")


def tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[_\-\s]+", snake_case(name)) if t]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggest(word: str, known: list[str], most: int = 2) -> str | None:
    near = min(((distance(word, k), k) for k in known), default=(most + 1, None))
    return near[1] if near[0] <= most else None


__all__ = ["distance", "normalise", "normalise_column", "singular", "snake_case", "stem", "suggest", "tokens", "tokens_column"]
