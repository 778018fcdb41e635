"""Text pools asked by executors: at once, at a rate, again after failures, and never twice."""

import time
from pathlib import Path

import pytest

from rowloom import api, textpool
from rowloom.errors import ConfigInvalid
from rowloom.schema import Column, Kind, Schema, Table

T = Table("t", (Column("id", Kind.INTEGER, nullable=False, auto_increment=True), Column("review", Kind.TEXT), Column("bio", Kind.VARCHAR, max_length=60)), ("id",))
S = Schema.of(T)


def counting(log: Path, fail_at: int | None = None, dies_after: int | None = None):
    """A provider that leaves a file for each request, as executors share no memory with the test."""

    def provider(prompt, n):
        import uuid

        asked = len(list(log.iterdir()))
        if dies_after is not None and asked >= dies_after:
            raise RuntimeError("killed")  # none of the failures that are tried again
        (log / uuid.uuid4().hex).write_text(prompt)
        if fail_at is not None and f"Write {fail_at} " in prompt:
            raise OSError("no answer")
        return [f"{prompt[:8]} {i}" for i in range(n)]

    return provider


def test_many_texts_at_once_killed_and_resumed(spark, tmp_path):
    log, cache = tmp_path / "log", textpool.Cache(str(tmp_path / "cache"))
    log.mkdir()
    how = textpool.Asking(at_once=8, batch=500)
    only = Schema.of(Table("t", T.columns[:2], ("id",)))
    with pytest.raises(Exception, match="killed"):
        textpool.ask_pools(spark, only, counting(log, dies_after=40), {"t": 100_000}, cache, how)
    before = len(list(log.iterdir()))
    assert 40 <= before <= 48  # those that were under way
    pools, warnings = textpool.ask_pools(spark, only, counting(log), {"t": 100_000}, cache, how)
    assert pools["t", "review"].count() == 100_000 and warnings == []
    assert len(list(log.iterdir())) == 200  # no request went out twice
    textpool.ask_pools(spark, only, counting(log), {"t": 100_000}, cache, how)
    assert len(list(log.iterdir())) == 200


def test_failures_are_tried_again_and_told(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    how = textpool.Asking(at_once=2, batch=50, tries=3, wait=0.01)
    pools, warnings = textpool.ask_pools(spark, S, counting(log, fail_at=20), {"t": 120}, None, how)
    assert pools["t", "review"].count() == 100 and len(warnings) == 2 and "1 of 3 requests failed: no answer" in warnings[0]
    assert len(list(log.iterdir())) == 2 * (2 + 3)
    assert max(len(r["text"]) for r in pools["t", "bio"].collect()) <= 60
    none, warnings = textpool.ask_pools(spark, S, counting(log, fail_at=7), {"t": 7}, None, how)
    assert none == {} and len(warnings) == 2


def test_costs_are_asked_first(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    seen = []
    how = textpool.Asking(price_in=1.0, price_out=2.0, confirm=lambda e: seen.append(e) or False)
    pools, warnings = textpool.ask_pools(spark, S, counting(log), {"t": 1000}, None, how)
    tokens = 2000 * textpool.TOKENS_OF_TEXT + 40 * textpool.TOKENS_OF_PROMPT
    assert pools == {} and seen == [textpool.Estimate(2000, 40, tokens, pytest.approx(1.7 * tokens / 1e6))] and "2000 in 40 requests" in warnings[0]
    with pytest.raises(ConfigInvalid, match="budget"):
        textpool.ask_pools(spark, S, counting(log), {"t": 1000}, None, textpool.Asking(price_out=5.0, budget=0.1))
    assert list(log.iterdir()) == []


def test_token_bucket():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = textpool.TokenBucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(9):
        bucket.take()
    assert slept == [0.5] * 6 and now[0] == 3.0
    now[0] += 100
    for _ in range(4):
        bucket.take()
    assert len(slept) == 7  # a rest saves up no more than the burst


def test_rate_holds_over_all_tasks(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    began = time.time()
    textpool.ask_pools(spark, Schema.of(Table("t", T.columns[:2], ("id",))), counting(log), {"t": 160}, None, textpool.Asking(at_once=4, batch=10, per_second=4.0))
    assert len(list(log.iterdir())) == 16 and time.time() - began >= 3 * 0.9  # four at once, then one a second each


def test_generated_rows_take_asked_texts(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    got = api.seed(spark, S, count=90, texts=counting(log), text_cache=textpool.Cache(str(tmp_path / "c")), asking=textpool.Asking(at_once=2))
    rows = got.tables["t"].collect()
    assert len(rows) == 90 and all(r["review"].startswith("Write ") for r in rows if r["review"]) and got.warnings == []
