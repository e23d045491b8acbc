"""Mixing sources to target weights by balanced sampling with the cube method.

A source's rate (target words by words there are) is split into whole copies of every
document and a fraction below one, the inclusion probability of one more copy.  The flight
phase (Deville and Tillé, "Efficient balanced sampling: the cube method", Biometrika 2004;
three units at a time after Chauvet and Tillé, 2006) moves those probabilities along the
null space of two constraints, the words and the documents taken, until they are 0 or 1.
It runs in blocks of bounded size; the at most two units a block leaves open go into the
next round of blocks, until one block per source is left, which also lands: a few last units are chosen outright.

Blocks of many small sources are decided by one task, one after another from sorted rows.  Targets are
found on the table of sources: the driver sees sums, never a row per source.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.llm.buckets import whole_buckets
from graphweir.llm.sharding import placed
from graphweir.plans.durable import ROW, durable, row_numbers

WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
BLOCK, LANDING, SEED, EPS = 4096, 12, "mix-1", 1e-9
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """``share`` of all words dealt by weight; none above ``most`` times its source's size.

    The law on a list, exactly; ``water_level`` is the same over a table.
    """
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total >= most * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(most * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def at_cap(level: Fraction, most: int = MOST) -> Column:
    """Whether a source's share at ``level`` words per unit of weight reaches ``most`` times its size; exact."""
    return F.col("size").cast("decimal(20,0)") * F.lit(Decimal(most * level.denominator)) <= F.col("weight").cast("decimal(9,0)") * F.lit(Decimal(level.numerator))


def water_level(sources: DataFrame, share: Fraction = SHARE, most: int = MOST) -> Fraction:
    """Words per unit of weight for the sources (size, weight) below their cap, so that all take ``share`` of the words.

    Each round caps the sources that the level reaches and deals the rest anew, which only raises it, until
    no more are reached: a few rounds, each one aggregation.
    """
    all_ = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    if not all_["weight"]:
        return Fraction(0)
    level = share * all_["size"] / all_["weight"]
    while True:
        full = sources.filter(at_cap(level, most)).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        open_ = all_["weight"] - full["weight"]
        raised = (share * all_["size"] - most * full["size"]) / open_ if open_ else level
        if raised == level:
            return level
        level = raised


def rates(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source of ``rows``, as a durable table: src_, source_size, target, whole copies of each document, and p, the fraction of one more."""
    per = placed(rows.groupBy("src").agg(F.sum("size").alias("size")), [F.col("src").asc_nulls_last()], "mix-sources")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    per = per.select("src", "size", turn.cast("bigint").alias("weight"))
    level = water_level(per)
    target = F.when(at_cap(level), F.col("size") * F.lit(float(MOST))).otherwise(F.col("weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator)))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    rated = per.withColumn("target", target).withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
    return durable(rated.select(F.col("src").alias("src_"), F.col("size").alias("source_size"), "target", "whole", (F.col("rate") - F.col("whole")).alias("p")), "mix-rates")


def flight(p: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """Moves ``p`` to 0 or 1 but for at most two entries; keeps sum(p) and sum(p * size)."""
    p, s, n = p.tolist(), size.tolist(), len(p)
    active, ahead = [], 0
    while True:
        active = [i for i in active if EPS < p[i] < 1 - EPS]
        while len(active) < 3 and ahead < n:
            if EPS < p[ahead] < 1 - EPS:
                active.append(ahead)
            ahead += 1
        if len(active) < 3:
            return np.array(p)
        a, b, c = active
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(active, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(active, u, strict=True):
            x = p[i] + step * d
            p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the open units (no more than LANDING + 2) so that words and documents come nearest."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = np.round(p)
    if len(open_):
        choice = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        moved = choice - p[open_]
        cost = np.abs(moved @ size[open_]) / max(1.0, float(size.mean())) + 0.1 * np.abs(moved.sum(axis=1))
        out[open_] = choice[int(np.argmin(cost))]
    return out


def decide(p: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """Flight and landing of a source's last block; ``size`` descends.

    A few units, spread over the sizes, stay out of the flight: with them the landing
    problem has choices enough to meet the totals closely.
    """
    waiting = np.unique(np.linspace(0, len(p) - 1, min(LANDING, len(p))).astype(int))
    flying = np.setdiff1d(np.arange(len(p)), waiting)
    out = p.copy()
    out[flying] = flight(p[flying], size[flying], rng)
    return land(out, size)


def fly(open_rows: DataFrame, level: int, last: bool, seed: str, batch: int = 20_000) -> DataFrame:
    """One round of flights, a block at a time; in the last round also the landing.

    A task decides the blocks it has from sorted rows, ``batch`` rows or one block at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, spans in whole_buckets(frames, ["src", "block"], batch, least=1):
            src, block = frame["src"].to_numpy(), frame["block"].to_numpy()
            p, size = frame["p"].to_numpy().copy(), frame["size"].to_numpy(np.int64)
            for s, e in spans:
                rng = random.Random(zlib.crc32(f"{seed}:{level}:{src[s]}:{block[s]}".encode()))
                p[s:e] = (decide if last else flight)(p[s:e], size[s:e], rng)
            yield frame.assign(p=p)

    # large documents are decided first, so that small ones are left to land
    ordered = open_rows.repartition("src", "block").sortWithinPartitions("src", "block", F.desc("size"), "key", ROW)
    return ordered.mapInPandas(run, open_rows.schema)


def largest(rows: DataFrame) -> int:
    """Rows of the source that has most."""
    return rows.groupBy("src").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``block``: rows of a source by a hash of their key, about ``size`` in each."""
    n = rows.groupBy("src").agg(F.ceil(F.count("*") / size).alias("n_")).withColumnRenamed("src", "src_")
    joined = rows.drop("block").join(n, F.col("src").eqNullSafe(F.col("src_")))
    return joined.withColumn("block", F.expr("pmod(key, n_)")).drop("src_", "n_")


def spread(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with keys of their own for those whose key more than ``most`` rows share (null or repeated ids), so that blocks stay even."""
    hot = rows.groupBy(F.col("key").alias("key_")).agg(F.count("*").alias("n_")).filter(F.col("n_") > most).drop("n_")
    own = F.when(F.col("key_").isNotNull(), F.xxhash64("key", ROW)).otherwise(F.col("key"))
    return rows.join(hot, F.col("key") == F.col("key_"), "left").withColumn("key", own).drop("key_")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies and ``__gw_row``.

    ``copies`` (0 to 2) is how often the mix holds the document, ``taken`` the words that
    makes.  Sources in code-point order, a null source last, weigh as ``weights`` repeats.
    A null or empty text has size 0 and is mixed by the documents' rate of its source.
    Rows that repeat an id count apart (in input order).  Sources without words have target
    0.  Very long texts are counted whole; no document exceeds twice its size.  There may be
    any number of sources.  An empty table gives an empty result;
    other columns are ignored, whatever their names.  Reruns agree.
    """
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            row_numbers(row_col),
            F.col(source_col).cast("string").alias("src"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("bigint").alias("size"),
            key.alias("key"),
        ),
        "mix-sizes",
    )
    rows = spread(rows, max(1, block // 8))
    rate = rates(rows, weights)
    open_ = rows.join(rate, F.col("src").eqNullSafe(F.col("src_"))).select("id", ROW, "src", "size", "key", "p").withColumn("block", F.lit(0).cast("bigint"))
    most = largest(open_)
    done, level = [], 0
    while True:
        last = most <= block
        flown = durable(fly(blocks(open_, block) if not last else open_.withColumn("block", F.lit(0).cast("bigint")), level, last, seed), "flight")
        if last:
            done.append(flown)
            break
        undecided = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(flown.filter(~undecided))
        open_, level = flown.filter(undecided), level + 1
        most = largest(open_)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumnRenamed("p", "x").join(rate, F.col("src").eqNullSafe(F.col("src_")))
    copies = F.col("whole") + F.when(F.col("p") > 0, F.round("x")).otherwise(0).cast("int")
    return out.withColumn("copies", copies).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", ROW)
