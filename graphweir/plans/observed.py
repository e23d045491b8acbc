"""Counts of a running job, taken from the rows as they pass instead of from a second read."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


def written(rows: DataFrame, path: str, kept: Column | None = None, **counts: Column) -> dict[str, int]:
    """Write the ``kept`` rows (all, if not given) as Parquet, and return aggregates of all rows that passed by."""
    seen = Observation()
    passing = rows.observe(seen, *[c.alias(name) for name, c in counts.items()])
    (passing if kept is None else passing.filter(kept)).write.parquet(path)
    return seen.get


class Progress(StreamingQueryListener):
    """Follows streams that are observed under ``name``: sums of their counts, batches, and a percentage between two marks.

    ``total`` is the number of rows that the stage is known to have, ``counter`` the count that is measured against it.
    """

    def __init__(self, name: str, counter: str, total: int, base: float = 20.0, share: float = 30.0):
        self.name, self.counter, self.total, self.base, self.share = name, counter, total, base, share
        self.counts: dict[str, int] = {}
        self.percents: list[float] = []
        self.ended = threading.Event()

    def percent(self) -> float:
        return self.base + self.share * (min(1.0, self.counts.get(self.counter, 0) / self.total) if self.total else 0.0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for k, v in row.asDict().items():
                self.counts[k] = self.counts.get(k, 0) + v
            self.percents.append(self.percent())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
