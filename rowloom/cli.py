"""Command line: read a schema, plan, generate, write."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .errors import RowloomError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("rowloom", description="Generate relational data from a schema")
    p.add_argument("schema", nargs="?", help="Prisma, Drizzle, TypeORM or JPA source, or a folder of it")
    p.add_argument("--config"), p.add_argument("--count", type=int), p.add_argument("--seed", type=int), p.add_argument("--locale"), p.add_argument("--url"), p.add_argument("--output"), p.add_argument("--format", default="sql", choices=["sql", "parquet", "csv", "copy"])
    p.add_argument("--only", action="append", default=[]), p.add_argument("--exclude", action="append"), p.add_argument("--strict", action="store_true"), p.add_argument("--dry-run", action="store_true"), p.add_argument("--inspect", action="store_true")
    p.add_argument("--yes", action="store_true", help="write to hosts that look like production"), p.add_argument("--schema", dest="schema_name", help="database schema, public by default"), p.add_argument("--jdbc", action="append", default=[], metavar="NAME=VALUE", help="reader and writer options, such as driver, user, password")
    p.add_argument("--existing-data", dest="existingData", choices=["augment", "truncate", "error", "merge"]), p.add_argument("--progress", action="store_true"), p.add_argument("--verbose", action="store_true"), p.add_argument("--version", action="store_true")
    p.add_argument("--batch-size", type=int, dest="batchSize"), p.add_argument("--json", action="store_true"), p.add_argument("--plugin", action="append", default=[]), p.add_argument("--scenario"), p.add_argument("--state")
    p.add_argument("--texts", metavar="MODULE:FUNCTION", help="provider of texts: (prompt, n) -> list of texts"), p.add_argument("--text-cache", metavar="FOLDER"), p.add_argument("--texts-at-once", type=int, metavar="N", help="requests that executors send at a time"), p.add_argument("--texts-per-second", type=float, metavar="N")
    p.add_argument("--texts-budget", type=float, metavar="COST"), p.add_argument("--texts-prices", type=float, nargs=2, default=(0.0, 0.0), metavar=("IN", "OUT"), help="for a million tokens")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.version:
        print(__version__)
        return 0
    try:
        from pyspark.sql import SparkSession

        from . import api, config, diff, plugins, schema, sources, textpool
        from .sources import introspect

        found = a.config or config.find_file()
        conf = config.merge(config.load_file(found) if found else config.validate({}), {k: getattr(a, k) for k in ("count", "seed", "locale", "url", "exclude", "batchSize", "scenario", "existingData")} | {"schema": a.schema_name})
        registry = plugins.Registry()
        for name in a.plugin:
            registry.register(plugins.load(name))
        spark = SparkSession.builder.appName("rowloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        url, jdbc = conf["connection"].get("url"), dict(x.split("=", 1) for x in a.jdbc)
        parsed = registry.parse(a.schema) if a.schema else None
        if parsed is None:
            # Without a source, the database says what its schema is.
            parsed = introspect.introspect(spark, url, conf["connection"]["schema"], allowed=a.yes, **jdbc) if url and not a.schema else sources.parse_any(a.schema or ".")
        parsed = config.inject_virtual_keys(parsed, conf["virtualForeignKeys"])
        parsed = schema.filter_schema(parsed, a.only, conf["exclude"], strict=a.strict).schema
        if a.inspect:
            print(schema.format_report(schema.inspect(spark, parsed)))
            return 0
        settings = config.generation_config(conf)
        settings.builders = registry.builder if registry.generators else None
        only = diff.to_regenerate(diff.load_state(a.state), parsed) if a.state else None
        mode = config.MODES[str(conf["existingData"]).lower()]
        tell = (lambda step, table, n: print(f"{step} {table}: {n} rows", file=sys.stderr)) if a.progress or a.verbose else None
        watch = (lambda p: print(p.line(), file=sys.stderr)) if a.progress else None
        asking = textpool.Asking(a.texts_at_once or 8, a.texts_per_second, budget=a.texts_budget, price_in=a.texts_prices[0], price_out=a.texts_prices[1]) if a.texts and (a.texts_at_once or a.texts_per_second or a.texts_budget is not None) else None
        got = api.run_pipeline(
            spark, parsed, settings, "target" if url else None, path=a.output, url=url, form=a.format, dry_run=a.dry_run, batch=conf["batchSize"], mode=mode, only=only, unchanged=only is not None, allowed=a.yes, jdbc=jdbc, progress=tell, watch=watch,
            texts=plugins.named(a.texts) if asking else textpool.with_retries(plugins.named(a.texts)) if a.texts else None, asking=asking, text_cache=textpool.Cache(a.text_cache) if a.text_cache else None,
        )
        if a.state:
            diff.save_state(a.state, parsed)
        s = got.summary
        print(json.dumps({"mode": s.mode, "rows": s.rows, "total": s.total, "seconds": round(s.seconds, 3), "warnings": s.warnings}) if a.json else f"{s.total} rows in {len(s.rows)} tables ({s.mode}, {s.seconds:.1f} s)")
        return 0
    except RowloomError as e:
        print(e.render(), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
