"""Prisma schema files."""

from __future__ import annotations

import re
from pathlib import Path

from ..errors import ParseFailed
from ..schema import Column, ForeignKey, Index, Kind, Schema, Table
from .scan import balanced, option, split_top, unquoted, without_comments

TYPES = {"String": Kind.TEXT, "Int": Kind.INTEGER, "BigInt": Kind.BIGINT, "Float": Kind.DOUBLE, "Decimal": Kind.DECIMAL, "Boolean": Kind.BOOLEAN, "DateTime": Kind.TIMESTAMPTZ, "Json": Kind.JSONB, "Bytes": Kind.BYTEA}
ACTIONS = {"Cascade": "CASCADE", "SetNull": "SET NULL", "SetDefault": "SET DEFAULT", "Restrict": "RESTRICT", "NoAction": "NO ACTION"}


def _attributes(text: str) -> dict[str, str]:
    """@name(arguments) by name; db.* keep their own names."""
    out, i = {}, 0
    for m in re.finditer(r"@@?([\w.]+)", text):
        if m.start() < i:
            continue
        args = ""
        if text[m.end() : m.end() + 1] == "(":
            i = balanced(text, m.end())
            args = text[m.end() + 1 : i - 1]
        out.setdefault(m[1], args)
    return out


def _names(args: str) -> list[str]:
    inner = option(args, "fields") or args
    m = re.search(r"\[([^\]]*)\]", inner)
    return [x.split("(")[0].strip() for x in split_top(m[1])] if m else []


def parse(source: str) -> Schema:
    text = without_comments(source)
    blocks = [(m[1], m[2], text[m.end() : balanced(text, m.end() - 1) - 1]) for m in re.finditer(r"^\s*(model|enum)\s+(\w+)\s*\{", text, re.M)]
    enums = {n: [re.sub(r'.*@map\("([^"]*)"\).*', r"\1", x) if "@map" in x else x.split()[0] for x in map(str.strip, body.splitlines()) if x and not x.startswith("@@")] for k, n, body in blocks if k == "enum"}
    models = {n: body for k, n, body in blocks if k == "model"}
    if not models:
        raise ParseFailed("no model in the Prisma schema")
    table_of, fields = {}, {}
    for n, body in models.items():
        block = _attributes("\n".join(x for x in body.splitlines() if x.strip().startswith("@@")))
        table_of[n] = unquoted(block.get("map", "")) or n
        rows = []
        for line in (x.strip() for x in body.splitlines()):
            m = re.match(r"(\w+)\s+(\w+(?:\(\"[^\"]*\"\))?)(\[\])?(\?)?\s*(.*)$", line)
            if m and not line.startswith("@@"):
                attrs = _attributes(m[5])
                rows.append((m[1], m[2], bool(m[3]), bool(m[4]), attrs, unquoted(attrs.get("map", "")) or m[1]))
        fields[n] = rows, block
    tables, lists = [], {}
    for n, (rows, block) in fields.items():
        column_of = {f: c for f, _, _, _, _, c in rows}
        columns, fks, uniques, pk = [], [], [], []
        for f, kind, many, optional, attrs, name in rows:
            if kind in models:
                if many:
                    lists.setdefault((n, kind), []).append((f, attrs))
                elif "relation" in attrs and _names(attrs["relation"]):
                    args = attrs["relation"]
                    refs = re.search(r"\[([^\]]*)\]", option(args, "references") or "")
                    target = {x[0]: x[5] for x in fields[kind][0]}
                    fks.append(ForeignKey(tuple(column_of[c] for c in _names(args)), table_of[kind], tuple(target[x.strip()] for x in refs[1].split(",")) if refs else ("id",), unquoted(option(args, "map") or "") or "", ACTIONS.get(option(args, "onDelete") or "", "NO ACTION"), ACTIONS.get(option(args, "onUpdate") or "", "NO ACTION")))
                continue
            default = attrs.get("default")
            length = next((int(re.sub(r"\D", "", v) or 0) or None for k, v in attrs.items() if k.lower() in ("db.varchar", "db.char")), None)
            k = Kind.ARRAY if many else Kind.ENUM if kind in enums else TYPES.get(kind.split("(")[0], Kind.UNKNOWN)
            if kind == "String" and (default in ("uuid()", "cuid()") or "db.Uuid" in attrs):
                k = Kind.UUID if default == "uuid()" or "db.Uuid" in attrs else Kind.TEXT
            elif length:
                k = Kind.VARCHAR
            decimals = [int(x) for x in re.findall(r"\d+", attrs.get("db.Decimal", ""))]
            columns.append(Column(name, k, kind, optional, default is not None or "updatedAt" in attrs, default, default == "autoincrement()", False, length, *(decimals if len(decimals) == 2 else (None, None)), tuple(enums.get(kind, ())) if not many else ()))
            if "id" in attrs:
                pk = [name]
            if "unique" in attrs:
                uniques.append((name,))
        pk = [column_of[x] for x in _names(block["id"])] if "id" in block else pk
        every = "\n".join(x.strip() for x in models[n].splitlines() if x.strip().startswith("@@"))
        uniques += [tuple(column_of[c] for c in _names(x)) for x in re.findall(r"@@unique\((.*)\)", every)]
        indexes = [Index("", tuple(column_of[c] for c in _names(x))) for x in re.findall(r"@@index\((.*)\)", every)]
        tables.append(Table(table_of[n], tuple(columns), tuple(pk), tuple(fks), tuple(uniques), indexes=tuple(indexes)))
    done = set()
    for (a, b), own in lists.items():
        # Two lists that face each other, without a key on either side: a bridge table.
        if (b, a) in lists and (min(a, b), max(a, b)) not in done:
            done.add((min(a, b), max(a, b)))
            named = next((unquoted(split_top(x["relation"])[0]) for _, x in own if x.get("relation") and ":" not in split_top(x["relation"])[0]), None)
            x, y = sorted((a, b))
            key_of = {t.name: (t.primary_key or ("id",)) for t in tables}
            ends = [Column(c, Kind.INTEGER, "Int", False) for c in "AB"]
            for i, m in enumerate((x, y)):
                t = next(t for t in tables if t.name == table_of[m])
                pk = next((c for c in t.columns if c.name in t.primary_key), None)
                if pk:
                    ends[i] = Column("AB"[i], pk.kind, pk.native, False)
            tables.append(Table(f"_{named}" if named else f"_{x}To{y}", tuple(ends), (), (ForeignKey(("A",), table_of[x], key_of[table_of[x]][:1]), ForeignKey(("B",), table_of[y], key_of[table_of[y]][:1])), (("A", "B"),)))
    return Schema.of(*tables, enums={k: tuple(v) for k, v in enums.items()}, name="prisma")


def parse_file(path: str) -> Schema:
    try:
        return parse(Path(path).read_text())
    except OSError as e:
        raise ParseFailed(f"{path} can't be read: {e}") from e
