"""Query timing: a bounded log of slow queries, and samples for the statistics operators."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SLOW_SECONDS, KEPT = 0.1, 100


class QueryLog:
    """Times of named queries; the slow ones are kept apart, the oldest dropped first."""

    def __init__(self, slow: float = SLOW_SECONDS, kept: int = KEPT, clock: Callable[[], float] = time.perf_counter):
        self.slow_after, self.clock = slow, clock
        self.samples: deque[tuple[str, float]] = deque(maxlen=100 * kept)
        self.slow: deque[tuple[str, float]] = deque(maxlen=kept)

    @contextmanager
    def timed(self, name: str):
        began = self.clock()
        try:
            yield
        finally:
            took = self.clock() - began
            self.samples.append((name, took))
            if took > self.slow_after:
                self.slow.append((name, took))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.samples), "query string, seconds double")


def hints(plan: str) -> list[str]:
    """What the text of a physical plan suggests to look at."""
    found = []
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        found.append("a join without an equality")
    if "BatchEvalPython" in plan:
        found.append("a row-at-a-time Python function")
    if "PushedFilters: []" in plan and "Filter" in plan:
        found.append("a scan whose filter is not pushed down")
    return found
