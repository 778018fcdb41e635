"""Pools of text for columns: from any table, or from a pluggable provider, with a cache. No network here:
a provider is a callable (prompt, n) -> list of texts that the user brings.

``pool_tables`` asks from the driver, a request at a time. ``ask_pools`` asks from executors, many at once: requests are
rows, dealt to as many partitions as may ask at a time, each of which holds to its share of the rate, tries again where
asking fails, and puts every answer into the cache as it comes. So a run that is killed goes on where it stopped, and a
task that runs again finds its answers there. What all of it may cost is told before anything is asked."""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigInvalid, RowloomError
from .schema import Column, Kind, Table
from .scratch import folder, materialise

WEEK = 7 * 86400
TOKENS_OF_PROMPT, TOKENS_OF_TEXT = 120, 60
PROMPTS = {"review": "a short customer review", "comment": "a reader's comment", "bio": "a two-sentence biography", "description": "a product description", "title": "a headline", "body": "a paragraph of an article", "message": "a short message"}
Provider = Callable[[str, int], list[str]]
BATCH, BLOCK = 50, 10_000
FAILURES = (RowloomError, OSError, ValueError, TimeoutError)


def eligible(c: Column) -> bool:
    return c.kind in (Kind.TEXT, Kind.VARCHAR) and not c.values and (c.max_length or 1000) >= 50 and any(k in c.name.lower() for k in PROMPTS)


def prompt(c: Column, table: Table, n: int) -> str:
    kind = next((v for k, v in PROMPTS.items() if k in c.name.lower()), "a realistic text")
    most = f" Each has at most {c.max_length} characters." if c.max_length else ""
    return f"Write {n} texts, each {kind} for the column {c.name} of a table of {table.name}.{most} Answer with a JSON array of strings."


def parse_answer(text: str, n: int) -> list[str]:
    """A JSON array, or else lines; repeated to n."""
    start, end = text.find("["), text.rfind("]")
    try:
        got = [str(x) for x in json.loads(text[start : end + 1])] if 0 <= start < end else []
    except ValueError:
        got = []
    got = got or [x.strip(" -*0123456789.)\t") for x in text.splitlines() if x.strip()]
    return [got[i % len(got)] for i in range(n)] if got else []


def with_retries(provider: Provider, tries: int = 3, wait: float = 1.0) -> Provider:
    def call(p: str, n: int) -> list[str]:
        for i in range(tries):
            try:
                return provider(p, n)
            except (OSError, TimeoutError):
                if i + 1 == tries:
                    raise
                time.sleep(wait * 2**i)
        return []

    return call


class Cache:
    def __init__(self, folder: str, seconds: float = WEEK):
        self.folder, self.seconds = Path(folder), seconds

    def _path(self, *key: str) -> Path:
        return self.folder / f"{hashlib.sha256('|'.join(key).encode()).hexdigest()[:16]}.json"

    def get(self, *key: str) -> list[str] | None:
        try:
            got = json.loads(self._path(*key).read_text())
            return got["texts"] if time.time() - got["at"] < self.seconds else None
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def put(self, texts: list[str], *key: str) -> None:
        """A whole file or none, whoever else writes or reads it."""
        self.folder.mkdir(parents=True, exist_ok=True)
        path = self._path(*key)
        aside = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
        aside.write_text(json.dumps({"at": time.time(), "texts": texts}))
        os.replace(aside, path)


def estimate_tokens(texts: int, prompts: int) -> int:
    return texts * TOKENS_OF_TEXT + prompts * TOKENS_OF_PROMPT


def estimate_cost(tokens: int, price_in: float, price_out: float) -> float:
    """Prices for a million tokens; three of ten go in."""
    return (0.3 * tokens * price_in + 0.7 * tokens * price_out) / 1e6


def batches(key: str, c: Column, t: Table, n: int, provider: Provider, cache: Cache | None = None, batch: int = BATCH) -> Iterator[list[str]]:
    """n texts for a column, ``batch`` or fewer in each request, none longer than the column; each request is cached."""
    for at in range(0, n, batch):
        want = min(batch, n - at)
        name = (key, c.name, str(want), *([str(at)] if at else []))
        got = cache.get(*name) if cache else None
        if got is None:
            got = provider(prompt(c, t, want), want)
            if cache and got:
                cache.put(got, *name)
        yield [x[: c.max_length] for x in got]


class TokenBucket:
    """At most ``rate`` takings a second, after a burst of ``size``."""

    def __init__(self, rate: float, size: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.size, self.clock, self.sleep = rate, max(1.0, size), clock, sleep
        self.held, self.at = self.size, clock()

    def take(self) -> None:
        now = self.clock()
        self.held = min(self.size, self.held + (now - self.at) * self.rate)
        self.at = now
        if self.held < 1:
            wait = (1 - self.held) / self.rate
            self.sleep(wait)
            self.held, self.at = 1.0, now + wait
        self.held -= 1


@dataclass(frozen=True)
class Estimate:
    texts: int
    requests: int
    tokens: int
    cost: float


@dataclass(frozen=True)
class Asking:
    """How executors ask: ``at_once`` requests at a time, ``per_second`` of them at most over all (None: no limit),
    ``tries`` for each, waiting ``wait`` seconds, then twice as long each time. ``budget``: what it may cost at most, by
    ``price_in`` and ``price_out`` for a million tokens. ``confirm``: asked with the estimate before anything is sent."""

    at_once: int = 8
    per_second: float | None = None
    tries: int = 3
    wait: float = 1.0
    batch: int = BATCH
    budget: float | None = None
    price_in: float = 0.0
    price_out: float = 0.0
    confirm: Callable[[Estimate], bool] | None = None


def estimate(schema, counts: dict[str, int], how: Asking) -> Estimate:
    """What filling all eligible columns takes; answers in a cache make it cheaper."""
    sizes = [n for *_, n in _columns(schema, counts)]
    requests = sum(-(-n // how.batch) for n in sizes)
    tokens = estimate_tokens(sum(sizes), requests)
    return Estimate(sum(sizes), requests, tokens, estimate_cost(tokens, how.price_in, how.price_out))


def asked(requests: Iterator[tuple[int, int]], key: str, c: Column, t: Table, provider: Provider, cache: Cache | None, how: Asking, share: int) -> Iterator[tuple[int, list[str], str]]:
    """(place, texts, error) of each request (place, number of texts), in one task; share: tasks that ask beside it."""
    bucket = TokenBucket(how.per_second / share) if how.per_second else None
    for at, want in requests:
        name = (key, c.name, str(want), *([str(at)] if at else []))
        got, error = cache.get(*name) if cache else None, ""
        for i in range(how.tries):
            if got is not None:
                break
            if bucket:
                bucket.take()
            try:
                got = provider(prompt(c, t, want), want)
                if cache and got:
                    cache.put(got, *name)
            except FAILURES as e:
                error = str(e) or type(e).__name__
                if i + 1 < how.tries:
                    time.sleep(how.wait * 2**i * (0.5 + random.random()))
        yield at, [x[: c.max_length] for x in got or []], "" if got is not None else error


def ask_pools(spark: SparkSession, schema, provider: Provider, counts: dict[str, int], cache: Cache | None = None, how: Asking | None = None) -> tuple[dict[tuple[str, str], DataFrame], list[str]]:
    """As ``pool_tables``, asked by executors; the provider is sent to them. The cache's folder has to be one that all
    of them see. Requests that fail in all their tries leave their texts out and are counted in the warnings; a column
    without any text is left to the usual generator. Nothing is asked where the estimate is over the budget, or
    ``confirm`` says no."""
    how = how or Asking()
    expected = estimate(schema, counts, how)
    if how.budget is not None and expected.cost > how.budget:
        raise ConfigInvalid(f"texts would cost {expected.cost:.2f}, over the budget of {how.budget:.2f}", hints=(f"{expected.texts} texts in {expected.requests} requests",))
    if how.confirm is not None and not how.confirm(expected):
        return {}, [f"texts weren't asked for: {expected.texts} in {expected.requests} requests, {expected.cost:.2f}"]
    pools, warnings = {}, []
    for key, t, c, n in _columns(schema, counts):
        number = -(-n // how.batch)
        share = max(1, min(how.at_once, number))

        def run(batches: Iterator[pd.DataFrame], key=key, c=c, t=t, share=share) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = zip(b["at"].tolist(), b["want"].tolist(), strict=True)
                for at, texts, error in asked(rows, key, c, t, provider, cache, how, share):
                    yield pd.DataFrame({"at": [at] * max(1, len(texts)), "text": texts or [None], "error": [error] * max(1, len(texts))})

        start = F.col("id") * how.batch
        requests = spark.range(0, number, 1, share).select(start.alias("at"), F.least(F.lit(how.batch), F.lit(n) - start).cast("int").alias("want"))
        answers = materialise(requests.mapInPandas(run, "at long, text string, error string"), "texts")
        failed = answers.where("error <> ''").agg(F.count("*").alias("n"), F.first("error", True).alias("error")).first()
        if failed["n"]:
            warnings.append(f"{key}.{c.name}: {failed['n']} of {number} requests failed: {failed['error']}")
        texts = answers.where("text is not null").select("text")
        if not texts.isEmpty():
            pools[key, c.name] = texts
    return pools, warnings


def _columns(schema, counts: dict[str, int]) -> Iterator[tuple[str, Table, Column, int]]:
    for key, t in schema.tables.items():
        n = counts.get(key, counts.get(t.name, 0))
        yield from ((key, t, c, n) for c in t.columns if n and eligible(c))


def build_pools(schema, provider: Provider, counts: dict[str, int], cache: Cache | None = None, batch: int = BATCH) -> tuple[dict[tuple[str, str], list[str]], list[str]]:
    """(pools by (table, column), warnings): as many texts as the table has rows, in memory; ``pool_tables`` is for
    more than that holds. Where a request fails, the texts before it stay; a column without any is left to the usual generator."""
    pools, warnings = {}, []
    for key, t, c, n in _columns(schema, counts):
        got: list[str] = []
        try:
            for texts in batches(key, c, t, n, provider, cache, batch):
                got += texts
        except FAILURES as e:
            warnings.append(f"{key}.{c.name}: {e}")
        if got:
            pools[key, c.name] = got
    return pools, warnings


def pool_tables(spark: SparkSession, schema, provider: Provider, counts: dict[str, int], cache: Cache | None = None, batch: int = BATCH, block: int = BLOCK) -> tuple[dict[tuple[str, str], DataFrame], list[str]]:
    """As ``build_pools``, for ``Config.text_pools``: texts go to a scratch table block by block, so the driver never holds
    more than ``block`` texts and a request's."""
    pools, warnings = {}, []
    for key, t, c, n in _columns(schema, counts):
        path, held, wrote = f"{folder(spark)}/texts-{uuid.uuid4().hex}", [], False
        requests = batches(key, c, t, n, provider, cache, batch)
        while True:
            try:
                texts = next(requests, None)
            except FAILURES as e:
                warnings.append(f"{key}.{c.name}: {e}")
                texts = None
            held += texts or []
            if held and (texts is None or len(held) >= block):
                spark.createDataFrame([(x,) for x in held], "text string").coalesce(1).write.mode("append").parquet(path)
                held, wrote = [], True
            if texts is None:
                break
        if wrote:
            pools[key, c.name] = spark.read.schema("text string").parquet(path)
    return pools, warnings
