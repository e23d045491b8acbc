"""Similarity join on word n-grams by MinHash banding.

Documents with the same set of five-word shingles form a class and go on as one row.  Band
hashes of their MinHash signatures are shuffled (a few bytes each).  In a bucket with at least
two classes, pairs are looked at by one bit of each MinHash value, which dismisses what met by chance;
the components of the pairs that are left are the candidate clusters.  Only the texts of one document per class in a cluster move on, once per
pair of blocks of their cluster; there all pairs are compared exactly on their full shingle
sets, by counting common shingles with matrix products.  A block returns link counts and a spanning set of links,
linear in its members, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.llm.buckets import candidate_links
from graphweir.llm.caches import kept
from graphweir.plans.components import connected_components
from graphweir.plans.durable import ROW, durable, row_numbers

NGRAM, THRESHOLD = 5, 0.8
#: 30 bands of 7 rows find a pair of similarity 0.8 with probability 0.9991, one of 0.3 with 0.007.
BANDS, BAND_ROWS = 30, 7
#: A pair of a bucket is dismissed if its signatures agree less than the threshold by so many standard deviations.
SIGMA = 4.0
#: What is hashed to that many slots can be broadcast whole, however long the table.
SLOTS = 1 << 20
#: Shingles that a block of a cluster should hold, and the most documents.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 2_000
#: Runs of anything but ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
_TABLE = str.maketrans(dict.fromkeys(BLANKS, " "))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` rows that find a pair at ``threshold`` with ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


class Shingler:
    """The distinct n-gram hashes of a text, sorted; word hashes are kept in a bounded cache."""

    def __init__(self, n: int = NGRAM, cached_words: int = 500_000):
        self.n, self.cached_words, self.known = n, cached_words, {}

    def words(self, text: str) -> list[str]:
        return [w for w in text.translate(_TABLE).split(" ") if w]

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text or "")
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.cached_words:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        grams = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            grams = (grams ^ (grams >> np.uint64(29))) * _MIX + h[k : len(h) - n + 1 + k]
        grams ^= grams >> np.uint64(32)
        return np.unique(grams * _MIX)


def shared_shingler(n: int) -> Shingler:
    """This process's shingler: words that one task has hashed serve the next."""
    return kept(("shingler", n), lambda: Shingler(n))


class MinHash:
    """Band hashes of shingle sets, and one bit of each value; permutations are seeded, the same everywhere."""

    def __init__(self, bands: int = BANDS, rows: int = BAND_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.fold = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 1024):
            x = shingles[i : i + 1024, None] * self.mul
            low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=0))
        bands = (low.reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=np.uint64).view(np.int64)
        return bands, np.packbits((low & np.uint64(1)).astype(bool)).tobytes()


def signatures(rows: DataFrame, n: int, bands: int, band_rows: int) -> DataFrame:
    """row, id, text digest, the size and a 128-bit digest of the shingle set, its band hashes and its sketch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, minhash = shared_shingler(n), MinHash(bands, band_rows)
        for frame in frames:
            for lo in range(0, len(frame), 1000):
                part = frame.iloc[lo : lo + 1000]
                sets = [shingler(t if isinstance(t, str) else None) for t in part["text"]]
                signed = [minhash(s) if len(s) else (np.zeros(0, np.int64), b"") for s in sets]
                yield pd.DataFrame({
                    ROW: part[ROW],
                    "id": part["id"],
                    "th": part["th"],
                    "size": [len(s) for s in sets],
                    "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "bands": [b.tolist() for b, _ in signed],
                    "sketch": [k for _, k in signed],
                })

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"{ROW} long, id {kind}, th string, size int, digest binary, bands array<long>, sketch binary")


def alike(values: int, threshold: float) -> Callable[[pd.DataFrame], Callable[[int, int], np.ndarray]]:
    """Which rows of a bucket may be similar: sketches of two sets differ in (1 - similarity) / 2 of their bits."""
    p = (1 - threshold) / 2
    most = values * p + SIGMA * np.sqrt(values * p * (1 - p))

    def near(frame: pd.DataFrame) -> Callable[[int, int], np.ndarray]:
        bits = np.unpackbits(np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1), axis=1, count=values)
        signs = np.where(bits, np.float32(1), np.float32(-1))
        return lambda s, e: (values - signs[s:e] @ signs[s:e].T) / 2 <= most

    return near


def placed(sets: list[np.ndarray], among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the shingles that are in ``among`` (sorted), by column."""
    x, row = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    hit = among[at] == x
    at, row = at[hit].astype(np.int32), row[hit]
    order = np.argsort(at, kind="stable")
    return at[order], row[order]


def common(left: list[np.ndarray], right: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """How many shingles each pair shares, by products of 0-1 matrices, ``width`` shingles at a time."""
    same = left is right
    if same:  # shingles of one set only cannot be shared
        x, n = np.unique(np.concatenate(left), return_counts=True)
        both = x[n > 1]
    else:
        both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out
    ca, ra = placed(left, both)
    cb, rb = (ca, ra) if same else placed(right, both)
    for lo in range(0, len(both), width):
        hi = min(lo + width, len(both))
        s, e = np.searchsorted(ca, [lo, hi])
        ux, at = np.unique(ra[s:e], return_inverse=True)
        x = np.zeros((len(ux), hi - lo), np.float32)
        x[at, ca[s:e] - lo] = 1
        if same:
            uy, y = ux, x
        else:
            s, e = np.searchsorted(cb, [lo, hi])
            uy, at = np.unique(rb[s:e], return_inverse=True)
            y = np.zeros((len(uy), hi - lo), np.float32)
            y[at, cb[s:e] - lo] = 1
        out[np.ix_(ux, uy)] += x @ y.T
    return out


def spanning(n: int, ends: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """A forest over ``n`` nodes that connects what the links connect."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*(e.tolist() for e in ends), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def compare(frame: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """Links between the blocks ``i`` and ``j`` of a cluster (within the block, if equal)."""
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    frame = frame.drop_duplicates("node").sort_values(["block", "node"])
    shingler = shared_shingler(n)
    sets = [shingler(t) for t in frame["text"]]
    node, copies, block = frame["node"].to_numpy(), frame["copies"].to_numpy(np.int64), frame["block"].to_numpy()
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    size = np.array([len(s) for s in sets], np.float64)
    links, ends = np.zeros(len(frame), np.int64), ([], [])
    if len(left) and len(right):
        sets_l = [sets[k] for k in left]
        shared = common(sets_l, sets_l if i == j else [sets[k] for k in right])
        for lo in range(0, len(left), 256):  # rows at a time: the matrices stay small
            rows = left[lo : lo + 256]
            part = shared[lo : lo + 256].astype(np.float64)
            hit = part >= threshold * (size[rows][:, None] + size[right][None, :] - part) - 1e-9
            if i == j:
                hit[np.arange(len(rows)), np.arange(lo, lo + len(rows))] = False
            links[rows] += hit @ copies[right]
            if i != j:
                links[right] += copies[rows] @ hit
            a, b = np.nonzero(hit)
            a, b = rows[a], right[b]
            ahead = a < b if i == j else slice(None)
            a, b = a[ahead], b[ahead]
            ends[0].append(a)
            ends[1].append(b)
    ends = tuple(np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)
    forest = spanning(len(frame), ends) if len(ends[0]) else []
    edges = pd.DataFrame({"a": [node[x] for x, _ in forest], "b": [node[y] for _, y in forest], "links": np.int64(0)})
    counts = pd.DataFrame({"a": node, "b": node, "links": links})
    return pd.concat([counts, edges], ignore_index=True).astype({"a": "int64", "b": "int64", "links": "int64"})


def blocked_pairs(members: DataFrame, weight: str, most_weight: int, most_rows: int, slim: DataFrame | None = None) -> DataFrame:
    """Each member of a cluster, once for every pair of blocks (i <= j) that its block is in.

    A cluster is cut into blocks by a hash of its members, so that a block holds about
    ``most_weight`` and ``most_rows`` at most; nearly all clusters are one block.  Where
    ``members`` are joined, ``slim`` has their clusters and weights for less work.
    """
    size = (members if slim is None else slim).groupBy("cluster").agg(F.greatest(F.ceil(F.sum(weight) / most_weight), F.ceil(F.count("*") / most_rows)).alias("nb"))
    dealt = members.join(size, "cluster").withColumn("block", F.expr("pmod(xxhash64(node), nb)"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1))
    return dealt.withColumn("o", other).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "nb")


def similarity_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, class_id, class_size, n_links, kept and ``__gw_row`` (``row_col``, or a number made for the row).

    Words are runs of anything but ASCII white space; a text of one to four words has one
    shingle, all its words.  Two rows are linked if their shingle sets have a Jaccard
    similarity of ``threshold`` or more; ``n_links`` counts the other rows a row is linked
    with, copies included, and ``class_id`` is the smallest id reachable by links (null
    ids come last).  A null or empty text has no shingles, links with nothing and is a class
    of its own, as is a repeated row of such a text.  Whole texts count, however long.  An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.col(text_col)
    rows = docs.select(row_numbers(row_col), F.col(id_col).alias("id"), text.alias("text"), F.md5(text).alias("th"))
    signed = durable(signatures(rows, n, bands, band_rows), "shingles")
    # classes of equal sets: the smallest row stands for them
    full = signed.filter("size > 0")
    same = durable(full.groupBy("digest").agg(F.min(ROW).alias("node"), F.count("*").alias("copies")), "same-sets")
    nodes = full.select(F.col(ROW).alias("node"), "th", "size", "bands", "sketch").join(same.select("node", "copies"), "node")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    entries = banded.join(buckets.filter("low < high").drop("high"), ["band", "h"]).join(nodes.select("node", "sketch"), "node")
    clusters = connected_components(candidate_links(entries, ["band", "h"], alike(bands * band_rows, threshold)))
    members = durable(clusters.select("node", F.col("component").alias("cluster")).join(nodes.select("node", "th", "size", "copies"), "node"), "members")
    # texts of clustered documents only: by slots of their digests first, which are few, then exactly; each text once
    slot = F.pmod(F.xxhash64("th"), F.lit(SLOTS)).alias("slot")
    slots = members.select(slot).distinct()  # at most SLOTS rows
    texts = rows.select("th", "text", slot).join(F.broadcast(slots), "slot", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    pairs = blocked_pairs(members, "size", BLOCK_SHINGLES, BLOCK_DOCS).join(texts, "th").select("cluster", "node", "copies", "block", "i", "j", "text")
    verified = durable(pairs.groupBy("cluster", "i", "j").applyInPandas(lambda f: compare(f, n, threshold), "a long, b long, links long"), "links")
    links = verified.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = connected_components(verified.filter("a <> b").select("a", "b"))
    by_set = (
        same.join(links, "node", "left")
        .join(classes, "node", "left")
        .select("digest", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    )
    slim = signed.select(ROW, "id", F.when(F.col("size") > 0, F.col("digest")).alias("digest"))
    out = slim.join(by_set, "digest", "left").select(ROW, "id", F.coalesce("component", ROW).alias("component"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = durable(out, "similar")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(ROW).alias("row"))).alias("first")
    named = durable(out.groupBy("component").agg(first, F.count("*").alias("class_size")), "classes")
    return out.join(named, "component").select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "class_size", "n_links", (F.col(ROW) == F.col("first.row")).alias("kept"), ROW)
