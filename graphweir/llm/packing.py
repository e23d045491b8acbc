"""Packing documents into windows by non-negative least squares over length combinations.

Every task packs its own documents, some millions of ids at a time.  What fills no window there, a few windows' worth of a task, is
shuffled into shards of some millions of ids, which are packed the same way, so that little is padded however many tasks there are.  Whole windows are cut from the
front of a document that is longer than one; what remains (up to a window) is hardly ever cut.  The
remains of a shard are described by the histogram of their lengths in units of 16 ids, rounded up.  All combinations
of up to three unit lengths that fill a window exactly are enumerated; non-negative least squares gives how
often each should repeat to use up the histogram (after Krell et al., "Efficient Sequence
Packing without Cross-contamination", 2021); the counts are rounded down, and residual documents go greedily to the fullest window that has room for them.
Those of windows that stay too empty wait for the next shard; with the last one they follow each other and are cut where a window ends.  A window
is padded by what its documents' lengths were rounded up.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.llm.tokens import shared_encoder
from graphweir.plans.durable import durable

WINDOW, UNIT, DEPTH, END_ID = 2048, 16, 3, 1
#: Windows of residual documents that are as full as this do not wait.
FULL = 0.97
#: Ids whose documents are packed together, and the bits of a task's own count of sequences in a sequence's id.
SHARD_IDS, SEQUENCE_BITS = 4_000_000, 33
#: Added to the task's number in the sequences of shards of what was left over.
LATER = 1 << 29


def combinations(total: int, depth: int) -> np.ndarray:
    """All ways to write ``total`` as 2 to ``depth`` positive parts; rows padded with zeros."""
    found: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], left: int) -> None:
        low = parts[-1] if parts else 1
        if parts and left >= low:
            found.append((*parts, left))
        if len(parts) < depth - 1:
            for p in range(low, left // 2 + 1):
                grow((*parts, p), left - p)

    grow((), total)
    return np.array([c + (0,) * (depth - len(c)) for c in sorted(set(found)) if len(c) > 1], np.int64).reshape(-1, depth)


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By the normal equations, which are small and well-behaved here; by singular values where they are not."""
    try:
        x = np.linalg.solve(a.T @ a, a.T @ b)
        if np.abs(x).max(initial=0.0) <= 1e6 * max(1.0, np.abs(b).max(initial=0.0)):  # false for what is not a number, too
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b| over x >= 0 by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, np.abs(b).max(initial=0.0)) * max(a.shape)
    for _ in range(rounds or 3 * n):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if not n or w[j] <= tol:
            break
        passive[j] = True
        while True:
            z = np.zeros(n)
            z[passive] = least_squares(a[:, passive], b)
            if (z[passive] > 1e-12).all():
                x = z
                break
            low = passive & (z <= 1e-12)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = np.maximum(x + step * (z - x), 0)
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def repeats(counts: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """How often each combination of lengths is used, from how many documents have each length."""
    a = np.zeros((len(counts), len(combos)))
    for d in range(combos.shape[1]):
        np.add.at(a, (combos[:, d], np.arange(len(combos))), combos[:, d] > 0)
    left = counts.copy()
    x = np.floor(nnls(a, left.astype(float)) + 1e-6).astype(np.int64)
    for k in np.flatnonzero((a @ x).astype(np.int64) > left):  # least squares may also overshoot
        for j in np.argsort(-x):
            over = int(a[k] @ x) - left[k]
            if over <= 0:
                break
            if a[k, j] and x[j]:
                x[j] -= min(x[j], -(-over // int(a[k, j])))
    left = left - (a @ x).astype(np.int64)
    for j in range(len(combos)):  # greedily, what rounding left over
        used = a[:, j] > 0
        more = int((left[used] // a[used, j].astype(np.int64)).min()) if used.any() else 0
        if more > 0:
            x[j] += more
            left[used] -= more * a[used, j].astype(np.int64)
    return x


def best_fit(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Windows of documents (by number), longest first, each into the fullest window that has room."""
    open_: list[list[list[int]]] = [[] for _ in range(window + 1)]  # by room left
    rooms: list[int] = []  # the rooms that there are, sorted
    out = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            room, held = window, []
            out.append(held)
        else:
            room = rooms[at]
            held = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
        held.append(i)
        room -= n
        if room:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append(held)
    return out


def streamed(members: list[int], lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces of documents that follow each other and are cut where a window ends."""
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for i in members:
        begin, n = 0, int(lengths[i])
        while begin < n:
            if not room:
                out.append([])
                room = window
            here = min(room, n - begin)
            out[-1].append((i, begin, here))
            begin, room = begin + here, room - here
    return out


def windows_of(lengths: np.ndarray, last: bool, most_waiting: int = SHARD_IDS // 2, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Windows of pieces (number, begin, length) of documents of these lengths, none longer than a window, and the documents that wait
    for the next shard: those of windows that are not full, unless they are too many ids or this is the ``last``; then they are cut."""
    per = window // unit
    bins = -(-lengths // unit)
    waiting = [np.flatnonzero(bins == k).tolist() for k in range(per + 1)]
    combos = np.concatenate([combinations(per, depth), np.array([[per] + [0] * (depth - 1)])])
    found: list[list[int]] = []
    x = repeats(np.array([len(w) for w in waiting], np.int64), combos) if len(lengths) else np.zeros(0, np.int64)
    for j in np.flatnonzero(x):
        parts = combos[j][combos[j] > 0].tolist()
        found.extend([waiting[k].pop() for k in parts] for _ in range(int(x[j])))
    left = np.array(sorted(i for w in waiting for i in w), np.int64)
    poor: list[int] = []
    for held in best_fit(lengths[left], window):
        members = left[held].tolist()
        if lengths[members].sum() >= FULL * window:
            found.append(members)
        else:
            poor.extend(members)
    out = [[(i, 0, int(lengths[i])) for i in members] for members in found]
    if last or int(lengths[poor].sum()) > most_waiting:
        out.extend(streamed(poor, lengths, window))
        poor = []
    return out, sorted(poor)


COLUMNS = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "doc_row"]


class Packer:
    """Gathers remains of documents (id, row, start, their ids as bytes of ``kind``, ids in all), and puts out the pieces of windows."""

    def __init__(self, first: int, kind: np.dtype, shard_ids: int, window: int, unit: int, depth: int):
        self.sequence, self.kind, self.shard_ids, self.shape = first, np.dtype(kind), shard_ids, (window, unit, depth)
        self.rests: list[tuple] = []
        self.held, self.out = 0, []

    def piece(self, key, row: int, start: int, raw: bytes, tokens: int, offset: int) -> None:
        ids = np.frombuffer(raw, self.kind).astype("<u4").tobytes()
        self.out.append((key, start, len(ids) // 4, ids, tokens, self.sequence, offset, row))

    def whole(self, key, row: int, start: int, raw: bytes, tokens: int) -> None:
        """A piece that fills a window alone."""
        self.piece(key, row, start, raw, tokens, 0)
        self.sequence += 1

    def rest(self, key, row: int, start: int, raw: bytes, tokens: int) -> None:
        self.rests.append((key, row, start, raw, tokens))

    def settle(self, last: bool) -> None:
        wide = self.kind.itemsize
        found, left = windows_of(np.array([len(r[3]) // wide for r in self.rests], np.int64), last, self.shard_ids // 2, *self.shape)
        for members in found:
            offset = 0
            for i, begin, length in members:
                key, row, start, raw, tokens = self.rests[i]
                self.piece(key, row, start + begin, raw[begin * wide : (begin + length) * wide], tokens, offset)
                offset += length
            self.sequence += 1
        self.rests, self.held = [self.rests[i] for i in left], 0

    def taken(self, dtype, waits: bool | None = None) -> Iterator[pd.DataFrame]:
        """What has come out since, in frames of bounded length; ``waits`` is a further column, if given."""
        for lo in range(0, len(self.out), 2000):
            frame = pd.DataFrame(self.out[lo : lo + 2000], columns=COLUMNS).astype({"id": dtype})
            yield frame if waits is None else frame.assign(waits=waits)
        self.out.clear()


def pack(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents: id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset, doc_row.

    Every document ends with ``end_id``; each of its ids lies in exactly one piece.  Offsets
    in a sequence run from 0 without a gap; what is missing to the window is padding, 3 % of it
    at most but for the last sequence of each shard of left-over documents, of which there is one for ``shard_ids`` of their ids.  A document
    is cut at whole windows from its start, and elsewhere only if no window was full enough with it.  A null or empty text is the end id alone.  Rows that repeat an id, or a
    null id, are documents of their own, told apart by ``doc_row``.  Very long texts give as many windows as they need.
    Sequences are numbered by task and then within it, with gaps between tasks.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, doc_row long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, row = shared_encoder(tokenizer), TaskContext.get().partitionId() << SEQUENCE_BITS
        end, wide, dtype = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize, None
        packer = Packer(row, encoder.dtype, shard_ids, window, unit, depth)
        for frame in frames:
            dtype = frame["id"].dtype
            for key, text in zip(frame["id"], frame["text"], strict=True):
                ids = (encoder.encode(text) if isinstance(text, str) else b"") + end
                tokens = len(ids) // wide
                whole = tokens - tokens % window
                for start in range(0, whole, window):
                    packer.whole(key, row, start, ids[start * wide : (start + window) * wide], tokens)
                if tokens > whole:
                    packer.rest(key, row, whole, ids[whole * wide :], tokens)
                row += 1
                packer.held += tokens
                if packer.held >= shard_ids:
                    packer.settle(False)
                    yield from packer.taken(dtype, False)
        if dtype is not None:
            packer.settle(False)
            yield from packer.taken(dtype, False)
            for key, own, start, raw, tokens in packer.rests:
                packer.piece(key, own, start, raw, tokens, 0)
            yield from packer.taken(dtype, True)

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, dtype = Packer((TaskContext.get().partitionId() + LATER) << SEQUENCE_BITS, np.dtype("<u4"), shard_ids, window, unit, depth), None
        for frame in frames:
            dtype = frame["id"].dtype
            for r in frame.itertuples(index=False):
                packer.rest(r.id, r.doc_row, r.start, r.ids, r.doc_tokens)
                packer.held += r.length
                if packer.held >= 2 * shard_ids:
                    packer.settle(False)
                    yield from packer.taken(dtype)
        if dtype is not None:
            packer.settle(True)
            yield from packer.taken(dtype)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = durable(rows.mapInPandas(run, schema + ", waits boolean"), "packed")
    waiting = first.filter("waits").drop("waits")
    left = waiting.agg(F.sum("length")).first()[0] or 0
    pieces = first.filter("not waits").drop("waits")
    if left:
        pieces = pieces.unionByName(waiting.repartition(-(-left // shard_ids)).mapInPandas(again, schema))
    return pieces.withColumnRenamed("id", id_col)


def with_checksum(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the ids themselves replaced by their CRC-32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "doc_row")
