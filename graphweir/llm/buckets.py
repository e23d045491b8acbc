"""Candidate links from the buckets of a hash index, by streaming over sorted rows.

A bucket of moderate size is looked at pair by pair, by what its rows carry (a few bytes
each); members that may be similar are linked.  A larger bucket links all its members to the smallest,
unseen: that is a superset, and what compares the linked rows exactly decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.plans.durable import durable, sized

#: Members of a bucket that is looked at.
MOST = 2_000


def whole_buckets(frames: Iterator[pd.DataFrame], keys: list[str], batch: int, least: int = 2) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames of whole buckets and the spans of those with ``least`` members or more, from frames sorted by ``keys``."""

    def spans(frame: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(frame) - 1, bool)
        for k in keys:
            v = frame[k].to_numpy()
            change |= v[1:] != v[:-1]
        return np.r_[0, np.flatnonzero(change) + 1, len(frame)]

    def cut(frame: pd.DataFrame, borders: np.ndarray) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
        return frame, [(s, e) for s, e in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True) if e - s >= least]

    waiting, held = [], 0
    for frame in frames:
        if len(frame):
            waiting.append(frame)
            held += len(frame)
        if held >= batch:
            frame = pd.concat(waiting, ignore_index=True)
            borders = spans(frame)
            if len(borders) > 2:  # the last bucket may go on
                yield cut(frame.iloc[: borders[-2]], borders[:-1])
                frame = frame.iloc[borders[-2] :]
            waiting, held = [frame], len(frame)
    if held:
        frame = pd.concat(waiting, ignore_index=True)
        yield cut(frame, spans(frame))


def stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first member of each component of a symmetric matrix to the others."""
    seen, a, b = np.zeros(len(near), bool), [], []
    for i in range(len(near)):
        if seen[i]:
            continue
        seen[i] = True
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & ~seen)
            seen[front] = True
            a.append(np.full(len(front), i))
            b.append(front)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def candidate_links(entries: DataFrame, keys: list[str], near: Callable[[pd.DataFrame], Callable[[int, int], np.ndarray]], batch: int = 50_000) -> DataFrame:
    """Distinct links a, b of ``entries`` (the keys of a bucket, its size n and least member low, the member node, and what ``near`` needs).

    ``near`` takes a frame and gives a function of a span of its rows that says, as a symmetric matrix, which may be similar;
    ``batch`` rows are gathered for a frame.
    """
    small = entries.filter(F.col("n") <= MOST).drop("n", "low")
    large = entries.filter((F.col("n") > MOST) & (F.col("node") != F.col("low"))).select(F.col("low").alias("a"), F.col("node").alias("b"))
    return _looked_at(small, keys, near, batch).unionByName(large).distinct()


def links_in_full_buckets(entries: DataFrame, keys: list[str], near: Callable[[pd.DataFrame], Callable[[int, int], np.ndarray]], batch: int = 50_000) -> DataFrame:
    """As ``candidate_links``, for an index that leaves few members alone: ``entries`` are all of them, without n and low.

    Only the large buckets are listed, of which there is one for ``MOST`` entries at most; a list of all buckets would grow with the
    entries, which are many times the rows that they were made of and that Spark estimates them by.
    """
    slim = entries.select(*keys, "node")
    counted = slim.groupBy(*keys).agg(F.count("*").alias("n"), F.min("node").alias("low")).filter(F.col("n") > MOST)
    large = sized(durable(counted.drop("n"), "large-buckets"))
    small = entries.join(large.drop("low"), keys, "left_anti")
    unseen = slim.join(large, keys).filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return _looked_at(small, keys, near, batch).unionByName(unseen).distinct()


def _looked_at(entries: DataFrame, keys: list[str], near: Callable[[pd.DataFrame], Callable[[int, int], np.ndarray]], batch: int) -> DataFrame:
    """Links of entries whose buckets are all looked at."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, spans in whole_buckets(frames, keys, batch):
            if not spans:
                continue
            test, node, a, b = near(frame), frame["node"].to_numpy(), [], []
            for s, e in spans:
                x, y = stars(test(s, e))
                a.append(node[s + x])
                b.append(node[s + y])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return entries.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")
