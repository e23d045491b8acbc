"""Near-duplicate embeddings by randomised-rotation binary codes.

Every distinct unit vector is turned by a seeded random rotation and stored once, as its sign
bits, with a correction factor (the inner product of the turned vector and its own code) and,
for the other side of a comparison, as four bits per dimension, rounded by a dither.  The inner
product of a code and another vector, divided by the factor, estimates their cosine without
bias; about a pair at the threshold it errs by sqrt(1 - f^2) / f * sin / sqrt(d - 1) (Gao and
Long, "RaBitQ", SIGMOD 2024) and by the rounding.

Bits of further rotations index the codes: vectors of one length that agree in all bits of one of several
tables meet in a bucket, where the corrected estimates and their bounds decide which pairs may
reach the threshold.  The components of these pairs are the candidate clusters; only their vectors move, and there
pairs whose bound reaches the threshold are recomputed exactly in double
precision.  Links are counted and spanned inside the blocks; no pairs are emitted.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.llm.buckets import links_in_full_buckets
from graphweir.llm.ngram_join import blocked_pairs, spanning
from graphweir.plans.components import connected_components
from graphweir.plans.durable import ROW, durable, row_numbers, sized

THRESHOLD, RECALL = 0.95, 0.99
#: Standard deviations of a corrected estimate that count as possible.
SIGMA = 4.0
#: Vectors that a bucket should hold, and rows of a block of a cluster.
BUCKET_BITS, BLOCK_ROWS, SEED = 5, 2_000, 11
#: Steps on either side of zero in four bits.
STEPS = 7
CODE = "code binary, factor float, step float, query binary"


def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` random orthogonal matrices beside each other: dim x (count * dim)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Tables and bits per table: buckets of about 2 ** BUCKET_BITS unrelated vectors, and the recall at the threshold."""
    bits = min(48, max(4, math.ceil(math.log2(max(n, 2))) - BUCKET_BITS))
    agree = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)), bits


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def clean(df: DataFrame, id_col: str, vec_col: str, row_col: str | None = None) -> tuple[DataFrame, np.dtype]:
    """row, id, the vector's bytes (null if it cannot link), and a digest of it; and the type of its components."""
    kind = np.dtype(np.float32 if df.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raws, digests = [], []
            for v in frame["v"]:
                x = None
                if v is not None and len(v) and not any(c is None for c in v):
                    x = np.asarray(v, kind)
                    x = x + kind.type(0) if np.isfinite(x).all() and x.any() else None
                raws.append(None if x is None else x.tobytes())
                digests.append(None if x is None else xxhash.xxh3_128_digest(raws[-1]))
            yield pd.DataFrame({ROW: frame[ROW], "id": frame["id"], "raw": raws, "digest": digests})

    rows = df.select(row_numbers(row_col), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInPandas(run, f"{ROW} long, id {df.schema[id_col].dataType.simpleString()}, raw binary, digest binary"), kind


def encoded(x: np.ndarray, turn: np.ndarray) -> pd.DataFrame:
    """Sign bits, correction factor, step and four-bit form of unit vectors, turned."""
    o = x @ turn
    sign = o > 0
    factor = np.where(sign, o, -o).sum(axis=1) / math.sqrt(o.shape[1])
    step = np.abs(o).max(axis=1) / STEPS
    dither = np.random.default_rng(SEED + 1).random(o.shape[1])
    level = np.clip(np.floor(o / step[:, None] + dither) + STEPS, 0, 2 * STEPS).astype(np.uint8)
    level = np.pad(level, ((0, 0), (0, level.shape[1] % 2)))
    query = level[:, ::2] | (level[:, 1::2] << 4)
    return pd.DataFrame({"code": [r.tobytes() for r in np.packbits(sign, axis=1)], "factor": factor.astype(np.float32), "step": step.astype(np.float32), "query": [r.tobytes() for r in query]})


class Estimates:
    """Corrected estimates of the cosines of stored vectors, and which may reach the threshold."""

    def __init__(self, rows: pd.DataFrame, dim: int, threshold: float):
        self.threshold = threshold
        self.factor, step = (rows[c].to_numpy(np.float32)[:, None] for c in ("factor", "step"))
        bits = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), axis=1, count=dim)
        self.code = np.where(bits, np.float32(1), np.float32(-1)) / (np.float32(math.sqrt(dim)) * self.factor)
        packed = np.frombuffer(b"".join(rows["query"]), np.uint8).reshape(len(rows), -1)
        level = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(rows), -1)[:, :dim]
        self.query = (level.astype(np.float32) - STEPS) * step
        # of a pair at the threshold: what the code misses, and the rounding of the other side
        self.missed = np.maximum(0, 1 - self.factor**2) * (1 - threshold**2) / max(dim - 1, 1)
        self.rounded = step**2 / 6

    def between(self, a: slice | np.ndarray, b: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and bounds of each of ``a`` with each of ``b``: the mean of both directions."""
        estimate = (self.query[a] @ self.code[b].T + self.code[a] @ self.query[b].T) / 2
        one = np.sqrt((self.missed[b].T + self.rounded[a]) / self.factor[b].T ** 2)
        other = np.sqrt((self.missed[a] + self.rounded[b].T) / self.factor[a] ** 2)
        return estimate, SIGMA * (one + other) / 2

    def possible(self, a: slice | np.ndarray, b: slice | np.ndarray) -> np.ndarray:
        estimate, bound = self.between(a, b)
        return estimate + bound >= self.threshold


def codes(nodes: DataFrame, kind: np.dtype, tables: int, bits: int) -> DataFrame:
    """One row per distinct vector, of any length: node, bytes, its key in each table, and its stored form (CODE)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned = functools.lru_cache(8)(lambda dim: (rotations(dim, 1), rotations(dim, math.ceil(tables * bits / dim), SEED + 2)[:, : tables * bits]))
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for frame in frames:
            for size, rows in frame.groupby("bytes"):
                turn, index = turned(size // kind.itemsize)
                for lo in range(0, len(rows), 2000):
                    part = rows.iloc[lo : lo + 2000]
                    x = unit(np.stack([np.frombuffer(r, kind) for r in part["raw"]]))
                    keys = ((x @ index) > 0).reshape(len(part), tables, bits) @ weights
                    out = encoded(x, turn).assign(node=part["node"].to_numpy(), bytes=np.int32(size), keys=list(keys))
                    yield out[["node", "bytes", "keys", "code", "factor", "step", "query"]]

    return nodes.select("node", "bytes", "raw").mapInPandas(run, f"node long, bytes int, keys array<long>, {CODE}")


def exact_links(left: np.ndarray, right: np.ndarray, possible: Callable[[int, int], np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of ``threshold`` or more (above the diagonal, if ``same``); only those that are ``possible`` are computed."""
    out = [], []
    for lo in range(0, len(left), 500):
        x, y = np.nonzero(possible(lo, min(lo + 500, len(left))))
        x += lo
        if same:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 50_000):
            xs, ys = x[k : k + 50_000], y[k : k + 50_000]
            hit = np.einsum("ij,ij->i", left[xs], right[ys]) >= threshold
            out[0].append(xs[hit])
            out[1].append(ys[hit])
    return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in out)


def compare(frame: pd.DataFrame, kind: np.dtype, threshold: float) -> pd.DataFrame:
    """Links between the blocks ``i`` and ``j`` of a cluster (within the block, if equal)."""
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    frame = frame.sort_values(["block", "node"])
    node, copies, block = frame["node"].to_numpy(), frame["copies"].to_numpy(np.int64), frame["block"].to_numpy()
    x = unit(np.stack([np.frombuffer(r, kind) for r in frame["raw"]]))
    known = Estimates(frame, x.shape[1], threshold)
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    links, a, b = np.zeros(len(frame), np.int64), [], []
    if len(left) and len(right):
        a, b = exact_links(x[left], x[right], lambda s, e: known.possible(left[s:e], right), threshold, i == j)
        a, b = left[a], right[b]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
    forest = spanning(len(frame), (a, b)) if len(a) else []
    edges = pd.DataFrame({"a": [node[p] for p, _ in forest], "b": [node[q] for _, q in forest], "links": np.int64(0)})
    return pd.concat([pd.DataFrame({"a": node, "b": node, "links": links}), edges], ignore_index=True).astype({"a": "int64", "b": "int64", "links": "int64"})


def embedding_classes(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", row_col: str | None = None) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept and ``__gw_row`` (``row_col``, or a number made for the row).

    Vectors are compared by cosine in double precision, whatever their other columns; a pair
    is linked if it was found with ``threshold`` or more.  A null, empty or zero vector, or
    one with null or non-finite components, links with nothing and is a component of its
    own.  Equal vectors are compared once and count as often as they occur; of rows that
    repeat the smallest id one is kept.  Vectors of different lengths never link.  An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    cleaned, kind = clean(df, id_col, vec_col, row_col)
    rows = durable(cleaned, "vectors")
    found = rows.filter("raw is not null")
    same = durable(found.groupBy("digest").agg(F.min(ROW).alias("node"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "same-vectors")
    verified = _links(same.withColumn("bytes", F.octet_length("raw")), kind, threshold, recall)
    links = verified.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = connected_components(verified.filter("a <> b").select("a", "b"))
    # all of these grow with the table and compress to a few bytes a row, so none is left to Spark to send whole
    by_vector = same.select("digest", "node", "copies").join(links.hint("merge"), "node", "left").join(classes.hint("merge"), "node", "left")
    by_vector = by_vector.select("digest", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.select(ROW, "id", "digest").join(by_vector, "digest", "left")
    out = durable(out.select(ROW, "id", F.coalesce("component", ROW).alias("component"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(ROW).alias("row"))).alias("first")
    named = durable(out.groupBy("component").agg(first), "vector-components")
    return out.join(named.hint("merge"), "component").select(F.col("id").alias(id_col), "n_links", F.col("first.id").alias("component_id"), (F.col(ROW) == F.col("first.row")).alias("kept"), ROW)


def _links(nodes: DataFrame, kind: np.dtype, threshold: float, recall: float) -> DataFrame:
    """Link counts (a = b) and spanning links of the distinct vectors, of all lengths at once: the length is part of a bucket's key."""
    known = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max("bytes"), F.lit(1)).alias("bytes")).first()
    tables, bits = tables_for(known["n"], threshold, recall)
    stored = durable(codes(nodes, kind, tables, bits), "codes")
    entries = stored.select("node", "bytes", "code", "factor", "step", "query", F.posexplode("keys").alias("t", "key"))

    def near(frame: pd.DataFrame) -> Callable[[int, int], np.ndarray]:
        size, made = frame["bytes"].to_numpy(), {}  # sorted by length

        def test(s: int, e: int) -> np.ndarray:
            if size[s] not in made:
                lo, hi = np.searchsorted(size, size[s], "left"), np.searchsorted(size, size[s], "right")
                made[size[s]] = lo, Estimates(frame.iloc[lo:hi], size[s] // kind.itemsize, threshold)
            lo, estimates = made[size[s]]
            return estimates.possible(slice(s - lo, e - lo), slice(s - lo, e - lo))

        return test

    candidates = links_in_full_buckets(entries, ["bytes", "t", "key"], near, max(2_000, 4_000_000 * kind.itemsize // known["bytes"]))
    clusters = connected_components(candidates).select("node", F.col("component").alias("cluster"))
    clusters = sized(durable(clusters, "vector-clusters")).withColumn("weight", F.lit(1))
    members = nodes.select("node", "copies", "raw").join(clusters, "node").join(stored.drop("keys", "bytes"), "node")
    # dealt by pairs of blocks, or all blocks of a cluster would stay in the task that the cluster is in
    pairs = blocked_pairs(members, "weight", BLOCK_ROWS, BLOCK_ROWS, clusters).repartition("cluster", "i", "j")
    return durable(pairs.groupBy("cluster", "i", "j").applyInPandas(lambda f: compare(f, kind, threshold), "a long, b long, links long"), "vector-links")
