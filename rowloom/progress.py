"""How far writing is: rows as they were written, their rate, and the time that is left.

Rows of a table are counted by an Observation while it is written, so the summary tells what went out, not what was
planned. Between tables, the share of a table's tasks that are done stands for the share of its rows."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Progress:
    table: str
    done: int
    total: int
    seconds: float

    @property
    def rate(self) -> float:
        """Rows a second."""
        return self.done / self.seconds if self.seconds > 0 else 0.0

    @property
    def left(self) -> float | None:
        """Seconds that the rest takes at this rate."""
        return (self.total - self.done) / self.rate if self.rate > 0 else None

    def line(self) -> str:
        share = 100 * self.done / self.total if self.total else 100.0
        left = "" if self.left is None else f", {self.left:.0f} s left"
        return f"{self.table}: {self.done} of {self.total} rows ({share:.0f} %), {self.rate:.0f} rows/s{left}"


class Counted:
    """A frame whose rows are counted as they are written (once)."""

    def __init__(self, df: DataFrame, name: str):
        self.observation = Observation(f"rows of {name}")
        self.frame = df.observe(self.observation, F.count(F.lit(1)).alias("rows"))

    @property
    def rows(self) -> int:
        return int(self.observation.get["rows"])


class Watch:
    """Tells a callback how far writing is, at most every ``every`` seconds, and at each table's end."""

    def __init__(self, spark: SparkSession, totals: dict[str, int], tell: Callable[[Progress], None] | None, every: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.totals, self.tell, self.every, self.clock = spark, totals, tell, every, clock
        self.total, self.done, self.written = sum(totals.values()), 0, {}
        self.began, self.last = clock(), float("-inf")

    def say(self, table: str, extra: int = 0, force: bool = False) -> None:
        now = self.clock()
        if self.tell is not None and (force or now - self.last >= self.every):
            self.last = now
            self.tell(Progress(table, min(self.total, self.done + extra), self.total, now - self.began))

    def share(self) -> float:
        """Tasks that are done of those in the stages that run."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
        tasks = sum(s.numTasks for s in stages if s)
        return sum(s.numCompletedTasks for s in stages if s) / tasks if tasks else 0.0

    @contextmanager
    def table(self, name: str, count: Callable[[], int]):
        """While a table is written; count: its rows, known when it is."""
        over = threading.Event()

        def look() -> None:
            while not over.wait(self.every):
                self.say(name, int(self.share() * self.totals.get(name, 0)))

        looking = threading.Thread(target=look, daemon=True)
        if self.tell is not None:
            looking.start()
        try:
            yield
        finally:
            over.set()
            if self.tell is not None:
                looking.join()
        self.written[name] = count()
        self.done += self.written[name]
        self.say(name, force=True)
