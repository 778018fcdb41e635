"""Plugins: parsers that supply a schema, generators that supply values."""

from __future__ import annotations

import importlib
import importlib.metadata
from typing import Protocol, runtime_checkable

from .errors import PluginInvalid
from .schema import Column, Schema, Table

GROUP = "rowloom.plugins"


@runtime_checkable
class Parser(Protocol):
    name: str

    def detect(self, path: str) -> bool: ...

    def parse(self, path: str) -> Schema: ...


@runtime_checkable
class ValueGenerator(Protocol):
    """names, suffixes and prefixes say which columns it takes; build(ctx) returns a Column."""

    name: str

    def build(self, ctx): ...


def check(plugin) -> str:
    """'parser' or 'generator', or an error that says what is missing."""
    if not isinstance(getattr(plugin, "name", None), str) or not plugin.name:
        raise PluginInvalid("a plugin needs a name")
    if isinstance(plugin, Parser) and callable(plugin.detect) and callable(plugin.parse):
        return "parser"
    if isinstance(plugin, ValueGenerator) and callable(plugin.build):
        if not any(getattr(plugin, k, None) for k in ("names", "suffixes", "prefixes")):
            raise PluginInvalid(f"{plugin.name}: a generator needs names, suffixes or prefixes")
        return "generator"
    raise PluginInvalid(f"{plugin.name}: neither detect() and parse() nor build()")


class Registry:
    def __init__(self):
        self.parsers: list[Parser] = []
        self.generators: list[ValueGenerator] = []

    def register(self, plugin) -> None:
        kind = check(plugin)
        have = self.parsers if kind == "parser" else self.generators
        if any(p.name == plugin.name for p in have):
            raise PluginInvalid(f"{plugin.name} is registered already")
        have.append(plugin)
        self.generators.sort(key=lambda p: -getattr(p, "priority", 0))

    def parse(self, path: str) -> Schema | None:
        """The schema of the first parser that knows the path."""
        found = next((p for p in self.parsers if p.detect(path)), None)
        return found.parse(path) if found else None

    def builder(self, column: Column, table: Table):
        name = column.name.lower()
        for p in self.generators:
            if name in getattr(p, "names", ()) or any(name.endswith(s) for s in getattr(p, "suffixes", ())) or any(name.startswith(s) for s in getattr(p, "prefixes", ())):
                return p.build
        return None


def named(target: str):
    """What 'module' (its ``plugin``) or 'module:attribute' names."""
    module, _, attribute = target.partition(":")
    try:
        found = importlib.import_module(module)
    except ImportError as e:
        raise PluginInvalid(f"plugin {target} can't be imported: {e}") from e
    got = getattr(found, attribute or "plugin", None)
    if got is None:
        raise PluginInvalid(f"{module} has no {attribute or 'plugin'}")
    return got


def load(target: str):
    """A plugin from 'module' or 'module:attribute'."""
    plugin = named(target)
    plugin = plugin() if isinstance(plugin, type) else plugin
    check(plugin)
    return plugin


def discover() -> list:
    return [e.load() for e in importlib.metadata.entry_points(group=GROUP)]
