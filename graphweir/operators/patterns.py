"""Pattern matching: hops, optional hops, existence tests, and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.operators.model import steps


def hop(rows: DataFrame, at: str, edges: DataFrame, to: str, types: list[str] | None = None, direction: str = "out", optional: bool = False, where: Column | None = None) -> DataFrame:
    """One step from the node in column ``at``; adds ``to``, ``to_eid`` and ``to_type``.

    ``where`` is a condition on the edge (src, dst, type, eid); for an optional hop it
    belongs to the match, so rows without a match stay, with nulls.
    """
    found = steps(edges, direction, types)
    if where is not None:
        found = found.filter(where)
    found = found.select(F.col("src").alias("__at"), F.col("dst").alias(to), F.col("eid").alias(f"{to}_eid"), F.col("type").alias(f"{to}_type"))
    return rows.join(found, F.col(at) == F.col("__at"), "left" if optional else "inner").drop("__at")


def attach(rows: DataFrame, at: str, nodes: DataFrame, prefix: str, optional: bool = False, where: Column | None = None) -> DataFrame:
    """The columns of the node in column ``at``, under ``prefix``."""
    found = nodes.filter(where) if where is not None else nodes
    found = found.select(F.col("id").alias("__id"), *[F.col(c).alias(prefix + c) for c in nodes.columns if c != "id"])
    return rows.join(found, F.col(at) == F.col("__id"), "left" if optional else "inner").drop("__id")


def having(rows: DataFrame, at: str, edges: DataFrame, types: list[str] | None = None, direction: str = "out", negate: bool = False) -> DataFrame:
    """Rows whose node has such an edge; with ``negate``, those without one."""
    found = steps(edges, direction, types).select(F.col("src").alias("__at")).distinct()
    return rows.join(found, F.col(at) == F.col("__at"), "left_anti" if negate else "left_semi")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in a total order."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__r = 1").drop("__r")


def top_by(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__r") <= n).drop("__r")


def match_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Maps each path (node_id, path) to the best file (file_id, path): equal, then the
    longest whole suffix either way, then the same basename, then the same stem of a Python
    file.  Ties go to the smaller path, so the result does not depend on input order.

    Each rule is an equi-join against files that were reduced to the best one per key
    first, so a basename that very many files share costs no pairs.
    """
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^(\\./|/)+", "")
    base = lambda c: F.substring_index(c, "/", -1)
    stem = lambda c: F.regexp_replace(c, r"\.py$", "")
    p = paths.select("node_id", norm(F.col("path")).alias("p"))
    f = files.select(F.struct(norm(F.col("path")).alias("q"), "file_id", F.col("path").alias("file_path")).alias("f"))

    def suffixes(c, least: int):
        """Proper suffixes (``least`` 1) or all (0) on component borders."""
        parts = F.split(c, "/")
        n = F.size(parts)
        cuts = F.when(n > least, F.sequence(F.lit(least + 1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(cuts, lambda i: F.array_join(F.slice(parts, i, n - i + 1), "/"))

    def best(key):
        return f.select(key.alias("k"), "f").groupBy("k").agg(F.min("f").alias("f"))

    q = F.col("f.q")
    whole = best(q)
    longer = f.select(F.explode(suffixes(q, 1)).alias("k"), "f").groupBy("k").agg(F.min("f").alias("f"))
    stems = f.select(stem(base(q)).alias("k"), base(q).alias("b"), "f").groupBy("k", "b").agg(F.min("f").alias("f"))
    found = [
        (p.select("node_id", F.col("p").alias("k")).join(whole, "k"), 0),
        (p.select("node_id", F.col("p").alias("k")).join(longer, "k"), 1),
        (p.select("node_id", F.explode(suffixes(F.col("p"), 1)).alias("k")).join(whole, "k"), 1),
        (p.select("node_id", base(F.col("p")).alias("k")).join(best(base(q)), "k"), 2),
        (p.select("node_id", stem(base(F.col("p"))).alias("k"), base(F.col("p")).alias("own")).join(stems, "k").filter("own <> b"), 3),
    ]
    each = [df.select("node_id", F.struct(F.lit(rank).alias("rank"), (-F.length("k") if rank == 1 else F.lit(0)).alias("len"), "f").alias("m")) for df, rank in found]
    picked = reduce(DataFrame.unionByName, each).groupBy("node_id").agg(F.min("m").alias("m"))
    return picked.select("node_id", "m.f.file_id", "m.f.file_path", "m.rank")
