"""A log of queries with their times: off unless a query is run through it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Entry:
    name: str
    plan: str
    start: float
    planned: float
    end: float

    @property
    def duration(self) -> float:
        return self.end - self.start


class QueryLog:
    """Runs actions on DataFrames and keeps when they began, were planned and ended, with their physical plan."""

    def __init__(self, most: int = 1000):
        self.entries: list[Entry] = []
        self.most = most

    def run(self, df: DataFrame, action: Callable[[DataFrame], Any] = DataFrame.collect, name: str = "") -> Any:
        start = time.time()
        plan = df._jdf.queryExecution().executedPlan().toString()
        planned = time.time()
        try:
            return action(df)
        finally:
            self.entries = [*self.entries[1 - self.most :], Entry(name, plan, start, planned, time.time())]

    def slowest(self, n: int = 10) -> list[Entry]:
        return sorted(self.entries, key=lambda e: -e.duration)[:n]
