"""Sampled trace events: what a read did and how long it took."""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Event:
    """One traced read: its kind, the physical operators in order, the filters that the scan got, rows returned, seconds."""

    read: str
    operators: tuple[str, ...]
    pushed: tuple[str, ...]
    rows: int
    seconds: float


class Tracer:
    """Runs reads and passes an event for every ``every``-th of them to ``sink`` (0: none)."""

    def __init__(self, sink: Callable[[Event], None], every: int = 1):
        self.sink, self.every, self.turn = sink, every, itertools.count(1)

    def collect(self, read: str, df: DataFrame) -> list[Row]:
        """Run a read whose rows the caller wants in the driver anyway."""
        return self._traced(read, df, df.collect, len)

    def write(self, read: str, df: DataFrame, path: str) -> None:
        """Run a read into Parquet files; only the number of its rows comes to the driver."""
        rows = Observation()
        self._traced(read, df, lambda: df.observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path), lambda _: rows.get["rows"])

    def _traced(self, read: str, df: DataFrame, run: Callable[[], Any], count: Callable[[Any], int]) -> Any:
        began = time.perf_counter()
        result = run()
        if self.every and next(self.turn) % self.every == 0:
            plan = df._jdf.queryExecution().executedPlan().toString()
            names = re.findall(r"^[\s:|+*()\d-]*([A-Z][A-Za-z]+)", plan, re.MULTILINE)
            pushed = re.findall(r"PushedFilters: \[(.*?)(?:\]|\.\.\.)(?:,|$)", plan, re.MULTILINE)
            self.sink(Event(read, tuple(names), tuple(p for p in pushed if p), count(result), time.perf_counter() - began))
        return result
