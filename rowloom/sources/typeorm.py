"""TypeORM entity classes."""

from __future__ import annotations

import re
from pathlib import Path

from ..errors import ParseFailed
from ..functions.names import snake_case
from ..schema import Column, ForeignKey, Kind, Schema, Table
from .catalog import kind_of_native
from .scan import balanced, option, quoted_strings, split_top, unquoted, without_comments

TS = {"string": Kind.VARCHAR, "number": Kind.INTEGER, "boolean": Kind.BOOLEAN, "Date": Kind.TIMESTAMP, "bigint": Kind.BIGINT, "Buffer": Kind.BYTEA, "object": Kind.JSON}
DATED = ("CreateDateColumn", "UpdateDateColumn", "DeleteDateColumn")


def _members(body: str):
    """(decorators {name: arguments}, property, optional, type) of each decorated property."""
    i, decorators = 0, {}
    while i < len(body):
        m = re.compile(r"\s*@(\w+)\s*").match(body, i)
        if m:
            i, args = m.end(), ""
            if body[i : i + 1] == "(":
                end = balanced(body, i)
                args, i = body[i + 1 : end - 1], end
            decorators[m[1]] = args
            continue
        m = re.compile(r"\s*(?:public |private |protected |readonly )*(\w+)\s*([?!]?)\s*:\s*([^;={\n]+)").match(body, i)
        if m and decorators:
            yield decorators, m[1], m[2] == "?" or "null" in m[3], m[3].strip()
            decorators, i = {}, m.end()
            continue
        if body[i] in "({[":
            i = balanced(body, i)
            decorators = {}
        else:
            i += 1


def parse(sources: list[str] | str) -> Schema:
    text = without_comments(sources if isinstance(sources, str) else "\n".join(sources))
    enums = {m[1]: tuple(quoted_strings(m[2]) or [x.split("=")[0].strip() for x in split_top(m[2])]) for m in re.finditer(r"enum\s+(\w+)\s*\{([^}]*)\}", text)}
    entities = {}
    for m in re.finditer(r"@Entity\s*\(", text):
        end = balanced(text, m.end() - 1)
        args = text[m.end() : end - 1]
        c = re.compile(r"[\s\S]*?class\s+(\w+)[^{]*\{").match(text, end)
        if c:
            name = unquoted(args) if args.strip()[:1] in "\"'`" and args.strip() else unquoted(option(args, "name") or "")
            entities[c[1]] = (name or snake_case(c[1]), args, text[c.end() : balanced(text, c.end() - 1) - 1], text[end : c.end()])
    if not entities:
        raise ParseFailed("no @Entity class in the TypeORM source")
    keys = {}
    for cls, (_, _, body, _) in entities.items():
        for d, prop, _, ts in _members(body):
            if "PrimaryGeneratedColumn" in d or "PrimaryColumn" in d:
                kind = Kind.UUID if "uuid" in d.get("PrimaryGeneratedColumn", "") else TS.get(ts, Kind.INTEGER)
                keys.setdefault(cls, (unquoted(option(d.get("PrimaryColumn", ""), "name") or "") or prop, kind))
    tables, bridges = [], []
    for cls, (name, _, body, head) in entities.items():
        columns, fks, uniques, pk, prop_column = [], [], [], [], {}
        for d, prop, optional, ts in _members(body):
            relation = next((r for r in ("ManyToOne", "OneToOne", "ManyToMany") if r in d), None)
            if relation in ("ManyToOne", "OneToOne"):
                if relation == "OneToOne" and "JoinColumn" not in d:
                    continue
                target = re.search(r"=>\s*(\w+)", d[relation]) or re.search(r"['\"](\w+)['\"]", d[relation])
                if not target or target[1] not in entities:
                    continue
                ref, kind = keys.get(target[1], ("id", Kind.INTEGER))
                opts = next((a for a in split_top(d[relation]) if a.startswith("{")), "")
                col = unquoted(option(d.get("JoinColumn", ""), "name") or "") or f"{prop}Id"
                ref = unquoted(option(d.get("JoinColumn", ""), "referencedColumnName") or "") or ref
                nullable = option(opts, "nullable")
                if col not in {c.name for c in columns}:
                    columns.append(Column(col, kind, "", nullable == "true" or (relation == "OneToOne" and nullable != "false") or (optional and nullable != "false")))
                fks.append(ForeignKey((col,), entities[target[1]][0], (ref,), on_delete=(unquoted(option(opts, "onDelete") or "") or "NO ACTION").upper(), on_update=(unquoted(option(opts, "onUpdate") or "") or "NO ACTION").upper()))
                prop_column[prop] = col
                if relation == "OneToOne":
                    uniques.append((col,))
            elif relation == "ManyToMany" and "JoinTable" in d:
                target = re.search(r"=>\s*(\w+)", d[relation])
                if target and target[1] in entities:
                    bridges.append((cls, target[1], unquoted(option(d["JoinTable"], "name") or "") or f"{name}_{prop}_{entities[target[1]][0]}"))
            else:
                which = next((x for x in ("PrimaryGeneratedColumn", "PrimaryColumn", "Column", *DATED, "VersionColumn") if x in d), None)
                if which is None:
                    continue
                args = d[which]
                parts = split_top(args)
                opts = next((a for a in parts if a.startswith("{")), "")
                col = unquoted(option(opts, "name") or "") or prop
                native = unquoted(parts[0]) if parts and parts[0][:1] in "\"'`" else unquoted(option(opts, "type") or "")
                values = option(opts, "enum")
                values = () if values is None else enums.get(values, ()) or tuple(quoted_strings(values))
                if which == "PrimaryGeneratedColumn":
                    kind = Kind.UUID if native == "uuid" else Kind.BIGINT if native == "bigint" else Kind.INTEGER
                elif values:
                    kind = Kind.ENUM
                elif native in ("simple-array",) or option(opts, "array") == "true":
                    kind = Kind.ARRAY
                elif native in ("simple-json",):
                    kind = Kind.JSON
                else:
                    kind = Kind.TIMESTAMP if which in DATED and not native else kind_of_native(native) if native else TS.get(re.sub(r"\s*\|\s*null", "", ts), Kind.TEXT)
                number = lambda key, o=opts: int(v) if (v := option(o, key)) and v.isdigit() else None
                is_pk = which.startswith("Primary")
                columns.append(Column(col, kind, native or ts, not is_pk and (option(opts, "nullable") == "true" or which == "DeleteDateColumn"), option(opts, "default") is not None or which in DATED, option(opts, "default"), which == "PrimaryGeneratedColumn" and kind is not Kind.UUID, bool(option(opts, "asExpression")), number("length"), number("precision"), number("scale"), values))
                prop_column[prop] = col
                if is_pk:
                    pk.append(col)
                if option(opts, "unique") == "true":
                    uniques.append((col,))
        for m in re.finditer(r"@Unique\s*\(([^)]*)\)|@Index\s*\(([^)]*unique\s*:\s*true[^)]*)\)", head + text[max(0, text.find(f"class {cls}") - 400) : text.find(f"class {cls}")]):
            cols = tuple(prop_column.get(x, x) for x in quoted_strings(re.search(r"\[([^\]]*)\]", m[0])[1])) if "[" in m[0] else ()
            if cols and set(cols) <= {c.name for c in columns}:
                uniques.append(cols)
        tables.append(Table(name, tuple(columns), tuple(pk), tuple(fks), tuple(dict.fromkeys(uniques))))
    for a, b, name in bridges:
        ends = [(f"{snake_case(x)}_id", *keys.get(x, ("id", Kind.INTEGER)), entities[x][0]) for x in (a, b)]
        tables.append(Table(name, tuple(Column(c, k, "", False) for c, _, k, _ in ends), tuple(c for c, *_ in ends), tuple(ForeignKey((c,), t, (r,)) for c, r, _, t in ends)))
    return Schema.of(*tables, enums=enums, name="typeorm")


def parse_directory(path: str) -> Schema:
    files = sorted(f for f in Path(path).rglob("*.ts") if not f.name.endswith((".test.ts", ".spec.ts", ".d.ts")) and "node_modules" not in f.parts)
    return parse([f.read_text() for f in files])
