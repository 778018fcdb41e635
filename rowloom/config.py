"""Configuration: files, environment variables, validation, scenarios, virtual keys."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import replace
from pathlib import Path

from .errors import BadScenario, BadVirtualKey, ConfigInvalid, MissingVariable, UnknownKey
from .functions.corpora import known
from .functions.names import suggest
from .functions.rng import DISTRIBUTIONS
from .operators.cardinality import from_config
from .operators.mapping import resolve_generator
from .schema import ForeignKey, Schema

FILE_NAMES = (".rowloom.yml", ".rowloom.yaml", "rowloom.yml", "rowloom.yaml")
MOST_BYTES = 10 << 20
DEFAULTS = {"connection": {"schema": "public"}, "seed": 42, "count": 50, "locale": "en", "existingData": "augment", "exclude": [], "tables": {}, "virtualForeignKeys": [], "scenarios": {}, "batchSize": 500}
KEYS = {
    "": {*DEFAULTS, "url", "output", "ai", "dryRun", "plugins", "scenario", "diff"}, "connection": {"url", "schema", "host", "port", "user", "password", "database"}, "table": {"count", "columns", "relationships"},
    "column": {"generator", "values", "weights", "cyclic", "nullable", "unique", "distribution", "min", "max"}, "relationship": {"cardinality", "distribution", "options"}, "key": {"source", "target"}, "end": {"table", "column", "columns"}, "ai": {"enabled", "provider", "model", "locale", "cacheDir", "temperature"},
}
MODES = {"augment": "append", "truncate": "overwrite", "error": "errorifexists", "merge": "merge"}


def find_file(start: str = ".") -> Path | None:
    here = Path(start).resolve()
    return next((p for d in (here, *here.parents) for n in FILE_NAMES if (p := d / n).is_file()), None)


def interpolate(value, env: Mapping[str, str] | None = None):
    """${NAME} from the environment, in every string."""
    env = os.environ if env is None else env
    if isinstance(value, str):

        def one(m: re.Match) -> str:
            if m[1] not in env:
                raise MissingVariable(f"environment variable {m[1]} isn't set")
            return env[m[1]]

        return re.sub(r"\$\{(\w+)\}", one, value)
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    return [interpolate(v, env) for v in value] if isinstance(value, list) else value


def load_file(path: str | Path, env: Mapping[str, str] | None = None) -> dict:
    import yaml

    path = Path(path)
    if path.stat().st_size > MOST_BYTES:
        raise ConfigInvalid(f"{path} is larger than {MOST_BYTES} bytes")
    try:
        raw = yaml.safe_load(path.read_text()) or {}
    except yaml.YAMLError as e:
        raise ConfigInvalid(f"{path} is no YAML: {e}") from e
    return validate(interpolate(raw, env))


def _known(found: Mapping, where: str, keys: str) -> None:
    for k in found:
        if k not in KEYS[keys]:
            near = suggest(str(k), sorted(KEYS[keys]))
            raise UnknownKey(f"unknown key '{k}' in {where or 'the configuration'}", hints=(f"did you mean '{near}'?",) if near else ())


def _table(value, where: str) -> Mapping:
    if not isinstance(value, Mapping):
        raise ConfigInvalid(f"{where} has to be a mapping")
    return value


def validate(raw) -> dict:
    """The configuration with defaults filled in, or an error that says where it is wrong."""
    _known(_table(raw, "the configuration"), "", "")
    out = {**DEFAULTS, **raw}
    out["connection"] = {**DEFAULTS["connection"], **_table(out["connection"], "connection")}
    _known(out["connection"], "connection", "connection")
    for k, least in (("count", 0), ("batchSize", 1)):
        if not isinstance(out[k], int) or isinstance(out[k], bool) or out[k] < least:
            raise ConfigInvalid(f"{k} has to be a whole number from {least} on")
    if not isinstance(out["seed"], int):
        raise ConfigInvalid("seed has to be a whole number")
    if str(out["existingData"]).lower() not in MODES:
        raise ConfigInvalid(f"existingData is one of {', '.join(MODES)}")
    if not isinstance(out["locale"], str):
        raise ConfigInvalid("locale has to be a text, such as de or de-AT")
    known(out["locale"])
    if not isinstance(out["exclude"], list) or not all(isinstance(x, str) for x in out["exclude"]):
        raise ConfigInvalid("exclude has to be a list of patterns")
    for name, t in _table(out["tables"], "tables").items():
        _known(_table(t, name), f"tables.{name}", "table")
        if "count" in t and (not isinstance(t["count"], int) or t["count"] < 0):
            raise ConfigInvalid(f"tables.{name}.count has to be a whole number from 0 on")
        for c, spec in _table(t.get("columns") or {}, f"tables.{name}.columns").items():
            validate_column(_table(spec, f"{name}.{c}"), f"tables.{name}.columns.{c}")
        for c, spec in _table(t.get("relationships") or {}, f"tables.{name}.relationships").items():
            if isinstance(spec, Mapping):
                _known(spec, f"tables.{name}.relationships.{c}", "relationship")
                if spec.get("distribution", "uniform") not in DISTRIBUTIONS:
                    raise ConfigInvalid(f"tables.{name}.relationships.{c}.distribution is one of {', '.join(DISTRIBUTIONS)}")
            from_config(spec)
    for key in out["virtualForeignKeys"]:
        _known(_table(key, "virtualForeignKeys"), "virtualForeignKeys", "key")
        for end in ("source", "target"):
            if end not in key:
                raise ConfigInvalid(f"a virtual key needs its {end}")
            _known(_table(key[end], end), f"virtualForeignKeys.{end}", "end")
    if "ai" in out:
        _known(_table(out["ai"], "ai"), "ai", "ai")
    validate_scenarios(out["scenarios"])
    return out


def validate_column(spec: Mapping, where: str) -> None:
    _known(spec, where, "column")
    if "generator" in spec:
        resolve_generator(spec["generator"])
    if "values" in spec and (not isinstance(spec["values"], list) or not spec["values"]):
        raise ConfigInvalid(f"{where}.values has to be a list that isn't empty")
    weights = spec.get("weights")
    if weights is not None and ("values" not in spec or len(weights) != len(spec["values"]) or min(weights) < 0 or sum(weights) <= 0):
        raise ConfigInvalid(f"{where}.weights need one number from 0 on for each value")
    if "nullable" in spec and not isinstance(spec["nullable"], bool) and not 0 <= spec["nullable"] <= 1:
        raise ConfigInvalid(f"{where}.nullable is true, false or a share from 0 to 1")
    if "distribution" in spec and spec["distribution"] not in DISTRIBUTIONS:
        raise ConfigInvalid(f"{where}.distribution is one of {', '.join(DISTRIBUTIONS)}")


def validate_scenarios(scenarios: Mapping) -> None:
    for name, spec in _table(scenarios, "scenarios").items():
        for t, n in _table(_table(spec, name).get("tables", {}), f"scenarios.{name}.tables").items():
            n = n.get("count") if isinstance(n, Mapping) else n
            if not isinstance(n, int) or n < 0:
                raise BadScenario(f"scenario {name}: {t} needs a whole number from 0 on")


def scenario_counts(config: Mapping, name: str) -> dict[str, int]:
    if name not in config["scenarios"]:
        near = suggest(name, list(config["scenarios"]))
        raise BadScenario(f"no scenario '{name}'", hints=(f"did you mean '{near}'?",) if near else ())
    return {t: n["count"] if isinstance(n, Mapping) else n for t, n in config["scenarios"][name].get("tables", {}).items()}


def merge(config: Mapping, options: Mapping) -> dict:
    """Options that are set win; exclude patterns add up."""
    out = {**config, **{k: v for k, v in options.items() if v is not None and k not in ("exclude", "url", "schema")}}
    out["exclude"] = list(dict.fromkeys([*config.get("exclude", []), *(options.get("exclude") or [])]))
    out["connection"] = {**config["connection"], **{k: options[k] for k in ("url", "schema") if options.get(k) is not None}}
    return out


def inject_virtual_keys(schema: Schema, keys: list[Mapping]) -> Schema:
    """A new schema with these foreign keys added."""
    tables = dict(schema.tables)
    for key in keys:
        ends = []
        for side in ("source", "target"):
            end = key[side]
            name = schema.resolve(end["table"])
            cols = tuple(end["columns"]) if "columns" in end else (end["column"],)
            if name is None or not set(cols) <= {c.name for c in tables[name].columns}:
                raise BadVirtualKey(f"virtual key: no column {','.join(cols)} in {end['table']}")
            ends.append((name, cols))
        (child, cols), (parent, refs) = ends
        if len(cols) != len(refs):
            raise BadVirtualKey(f"virtual key of {child}: {len(cols)} columns refer to {len(refs)}")
        tables[child] = replace(tables[child], foreign_keys=(*tables[child].foreign_keys, ForeignKey(cols, parent, refs, virtual=True)))
    return Schema(tables, schema.enums, schema.name)


def generation_config(config: Mapping):
    """The generator's settings: counts, column overrides, cardinalities."""
    from .operators.generate import Config

    over, counts, card = {}, {}, {}
    for name, t in config["tables"].items():
        if "count" in t:
            counts[name] = t["count"]
        for c, spec in (t.get("columns") or {}).items():
            spec = dict(spec)
            if "generator" in spec:
                spec["builder"] = resolve_generator(spec.pop("generator"))
            if "nullable" in spec:
                spec["nullable"] = float(spec["nullable"]) if not isinstance(spec["nullable"], bool) else (0.1 if spec["nullable"] else 0.0)
            over.setdefault(name, {})[c] = spec
        for c, spec in (t.get("relationships") or {}).items():
            card.setdefault(name, {})[c] = from_config(spec)
    if config.get("scenario"):
        counts |= scenario_counts(config, config["scenario"])
    return Config(seed=config["seed"], rows=config["count"], rows_of=counts, overrides=over, cardinality=card, locale=config["locale"])
