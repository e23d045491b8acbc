"""Deduplication of repeated line runs by prefix doubling over line identifiers.

Every line begins a suffix of its document's sequence of line identifiers.  Doubling ranks
the suffixes by their first 1, 2, 4, ... lines; a rank is a class of suffixes that agree so
far, an integer: the number of its first member among the lines.  The classes are the intervals of the
suffix array whose longest common prefix is at least that long; a suffix that agrees with no
other belongs to none and drops out.  Two overlapping ranks name a run of any length, so
each run that just reaches the least number of words, forward from a line or backward from
one, can be looked up: if its class has an earlier member, it is a later copy.  The union of
the later copies is the set of lines that lie in a maximal repeat with an earlier occurrence
(a line of such a repeat lies in a shortest one that begins or ends with it, or is spanned
by one), and they are deleted.

Each step is an aggregation and a join on ranks or places.  No class's members are gathered
in one place; only a document's own lines are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.plans.durable import ROW, durable

#: A repeated run is deleted if it has this many words or more.
MIN_WORDS = 20
#: A task numbers its lines in so many bits.
TASK_BITS = 40


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run of ``least`` words that begins, and that ends, at each line; 0 for none."""
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + least, "left")  # the first border that is far enough
    forward = np.where(end <= len(words), end - at, 0)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    backward = np.where(total[1:] >= least, at + 1 - begin, 0)
    return np.maximum(forward, 1) * (forward > 0), backward


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """pos, left, name (a 128-bit digest of the line), the shortest runs from and to it, and id, row and line.

    ``pos`` numbers the lines of a task, so those of a document follow each other; ``left`` counts its lines from there on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos = TaskContext.get().partitionId() << TASK_BITS
        for frame in frames:
            for lo in range(0, len(frame), 1000):
                part = frame.iloc[lo : lo + 1000]
                lines = [t.encode("utf-8", "surrogatepass").split(b"\n") if isinstance(t, str) else [] for t in part["text"]]
                n = [len(x) for x in lines]
                runs = [shortest_runs(np.fromiter((len(y.split()) for y in x), np.int64, len(x)), least) for x in lines]
                yield pd.DataFrame({
                    "id": part["id"].repeat(n),
                    ROW: part[ROW].repeat(n),
                    "line": np.concatenate([np.arange(k) for k in n]) if n else [],
                    "pos": np.arange(pos, pos + sum(n)),
                    "left": np.concatenate([np.arange(k, 0, -1) for k in n]) if n else [],
                    "name": [xxhash.xxh3_128_digest(y) for x in lines for y in x],
                    "forward": np.concatenate([r[0] for r in runs]) if n else [],
                    "backward": np.concatenate([r[1] for r in runs]) if n else [],
                })
                pos += sum(n)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.filter("text is not null").mapInPandas(run, f"id {kind}, {ROW} long, line long, pos long, left long, name binary, forward long, backward long")


def ranked(keyed: DataFrame, key: list[str]) -> DataFrame:
    """pos, left, name: the first position of each class of at least two suffixes with equal ``key``."""
    classes = keyed.groupBy(*key).agg(F.min("pos").alias("name"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(classes.withColumnsRenamed({k: f"{k}_" for k in key}), [F.col(k) == F.col(f"{k}_") for k in key]).select("pos", "left", "name")


def at(ranks: DataFrame, name: str) -> DataFrame:
    return ranks.select(F.col("pos").alias("pos_"), F.col("name").alias(name))


def doubled(lines: DataFrame, longest: int) -> list[DataFrame]:
    """The ranks by the first 2 ** k lines, for all k that a run of ``longest`` lines needs."""
    levels = [durable(ranked(lines.select("pos", "left", F.col("name").alias("key")), ["key"]), "ranks")]
    while 2 ** len(levels) <= longest:
        now, step = levels[-1], 2 ** (len(levels) - 1)
        pairs = now.filter(F.col("left") > step).join(at(now, "next"), F.col("pos") + step == F.col("pos_")).select("pos", "left", F.col("name").alias("key"), "next")
        levels.append(durable(ranked(pairs, ["key", "next"]), "ranks"))
    return levels


def later_copies(lines: DataFrame) -> DataFrame:
    """row, start, length of every shortest run that also begins at an earlier place."""
    row = ["id", ROW]
    begin = lines.filter("forward > 0").select(*row, "line", "pos", F.col("forward").alias("length"))
    back = F.col("backward") - 1
    end = lines.filter("backward > 0").select(*row, (F.col("line") - back).alias("line"), (F.col("pos") - back).alias("pos"), F.col("backward").alias("length"))
    longest = begin.unionByName(end).agg(F.coalesce(F.max("length"), F.lit(0)).alias("n")).first()["n"]
    levels = doubled(lines, longest)
    runs = begin.unionByName(end).dropDuplicates(["pos", "length"])
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col(ROW).alias("row"), F.col("line").alias("line"))
    found = None
    for k, ranks in enumerate(levels):
        here = runs.filter(F.col("length").between(2**k, 2 ** (k + 1) - 1))
        named = here.join(at(ranks, "a"), F.col("pos") == F.col("pos_")).drop("pos_")
        named = named.join(at(ranks, "b"), F.col("pos") + F.col("length") - 2**k == F.col("pos_")).select("length", "a", "b", place.alias("place"))
        classes = named.groupBy("length", "a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        copies = named.join(classes, ["length", "a", "b"]).filter(F.col("first") < F.col("place"))
        copies = copies.select(F.col("place.row").alias(ROW), F.col("place.line").alias("start"), "length")
        found = copies if found is None else found.unionByName(copies)
    return found


def without_repeats(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_lines, deleted (spans of lines, end excluded), n_deleted, kept_text.

    Lines end with a line feed; words are runs of anything but ASCII white space.  A line is
    deleted if it lies in a run of lines with ``least`` words or more that also begins at an
    earlier place: in a row with a smaller id (null ids last, repeated ids in input order) or
    further up in the same text.  A null text has no lines and stays null, an empty one has
    one empty line.  Texts may have any number of lines.  An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias(ROW))
    rows = durable(picked, "tagged")
    lines = durable(line_table(rows, least), "lines")
    spans = later_copies(lines).groupBy(ROW).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, row, text, spans in zip(frame["id"], frame[ROW], frame["text"], frame["spans"], strict=True):
                lines = text.split("\n") if isinstance(text, str) else []
                gone = np.zeros(len(lines) + 2, bool)
                for s in spans if spans is not None else []:
                    gone[s["start"] + 1 : s["start"] + 1 + s["length"]] = True
                border = np.flatnonzero(np.diff(gone.astype(np.int8)))
                kept = "\n".join(x for x, d in zip(lines, gone[1:], strict=False) if not d) if isinstance(text, str) else None
                out.append((key, row, len(lines), [{"start": int(a), "end": int(b)} for a, b in border.reshape(-1, 2)], int(gone.sum()), kept))
            yield pd.DataFrame(out, columns=["id", ROW, "n_lines", "deleted", "n_deleted", "kept_text"]).astype({"id": frame["id"].dtype})

    marked = rows.join(spans, ROW, "left").select("id", ROW, "text", "spans")
    schema = f"id {kind}, {ROW} long, n_lines int, deleted array<struct<start:int,end:int>>, n_deleted int, kept_text string"
    return marked.mapInPandas(cut, schema).withColumnRenamed("id", id_col)


def digest(rows: DataFrame) -> DataFrame:
    """The query's columns: texts replaced by their length in bytes and SHA-256."""
    return rows.select("doc_id", "n_lines", "n_deleted", "deleted", F.octet_length("kept_text").alias("kept_bytes"), F.sha2("kept_text", 256).alias("kept_sha256"))
