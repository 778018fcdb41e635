"""Schema sources."""

from pathlib import Path

from ..errors import ParseFailed
from ..schema import Schema


def parse_any(path: str) -> Schema:
    """A schema from a file or folder, by what it holds."""
    from . import catalog, drizzle, jpa, prisma, typeorm

    p = Path(path)
    if p.suffix == ".prisma":
        return prisma.parse_file(path)
    if p.suffix in (".db", ".sqlite", ".sqlite3"):
        return catalog.sqlite_schema(path)
    if p.is_dir() and (found := next(iter(sorted(p.rglob("schema.prisma"))), None)):
        return prisma.parse_file(str(found))
    if p.suffix == ".java" or (p.is_dir() and any(p.rglob("*.java"))):
        return jpa.parse_directory(path)
    if p.suffix == ".ts":
        text = p.read_text()
        return typeorm.parse(text) if "@Entity" in text else drizzle.parse(text)
    if p.is_dir() and (files := [f for f in p.rglob("*.ts") if "node_modules" not in f.parts]):
        return typeorm.parse_directory(path) if any("@Entity" in f.read_text() for f in files) else drizzle.parse_file(path)
    raise ParseFailed(f"no schema in {path}")
