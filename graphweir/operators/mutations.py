"""Mutations as new snapshots: every function returns the frame after the change.

Parquet has no update in place; ``plans.durable`` or a table swap makes a snapshot current.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(*key: Column) -> Column:
    """A deterministic node id from its business key."""
    return F.sha2(F.to_json(F.array(*[k.cast("string") for k in key])), 256)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace what they set (non-null values) in rows of ``old`` or are added."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    columns = list(dict.fromkeys(old.columns + new.columns))

    def value(c: str) -> Column:
        sides = [F.col(f"{s}.{c}") for s, df in (("b", new), ("a", old)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    return a.join(b, on, "full_outer").select(*[value(c) for c in columns])


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the edges whose (src, dst, type) is not there yet; repeats among the new count once."""
    fresh = new.dropDuplicates(["src", "dst", "type"]).join(old.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return old.unionByName(fresh.select(old.columns))


def set_properties(props: Column, more: Column) -> Column:
    """``props`` with the entries of ``more``, which win."""
    keep = F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(more, k))
    return F.when(more.isNull(), props).otherwise(F.map_concat(keep, more))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in ``gone`` (a frame of ids) and the edges at them."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()
    left = nodes.join(ids, F.col("id") == F.col("__gone"), "left_anti")
    kept = edges.join(ids, F.col("src") == F.col("__gone"), "left_anti").join(ids, F.col("dst") == F.col("__gone"), "left_anti")
    return left, kept


def clear(frame: DataFrame, code: str, expected: str = "CONFIRM") -> DataFrame:
    """The empty frame, if the confirmation code is right."""
    if code != expected:
        raise PermissionError("wrong confirmation code; nothing was cleared")
    return frame.limit(0)
