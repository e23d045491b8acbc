"""Connected components of an edge list, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.plans import durable
from graphweir.plans.durable import Generations


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node that occurs in ``edges``.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", SoCC 2014) until the edge set is a set of stars.  Each step is one
    aggregation and one join; a node's neighbours are never gathered in one place, so a hub
    with a third of all links only costs partial aggregates and a join that AQE can split.
    Every round is written to the shared folder, which cuts the lineage.  Rounds never have more
    links than the first one; where it has many, no join sends a table whole.

    Null ends and self links are ignored; repeated links count once; an empty edge list
    gives an empty result.  Returns ``node`` and ``component``.
    """
    spark = edges.sparkSession
    kind = edges.select(a).schema[0].dataType
    pairs = (
        edges.select(F.col(a).cast(kind).alias("u"), F.col(b).cast(kind).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    kept = Generations(spark, "components")
    pairs = kept.put(pairs)
    shuffled = pairs.count() > durable.SENT_ROWS
    state = None
    for _ in range(max_rounds):
        pairs = kept.put(_small_star(_large_star(pairs, shuffled), shuffled))
        # every node hangs below exactly one smaller node, and that node is a root
        seen = pairs.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        if state == tuple(seen):
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _lowest(low: DataFrame, shuffled: bool) -> DataFrame:
    return low.hint("merge") if shuffled else low


def _large_star(pairs: DataFrame, shuffled: bool) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node around it."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return (
        both.filter("v > u").join(_lowest(low, shuffled), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    )


def _small_star(pairs: DataFrame, shuffled: bool) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(_lowest(low, shuffled), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
