"""Variable-length paths, reachability and path-prefix trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.operators.model import steps
from graphweir.plans.components import connected_components
from graphweir.plans.durable import Generations, durable

__all__ = ["ancestors", "climb", "connected_components", "pairs_between", "paths", "prefix_tree", "reachable", "typed_paths"]


def paths(starts: DataFrame, edges: DataFrame, least: int, most: int, direction: str = "out", types: list[str] | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Trails of ``least`` to ``most`` edges: start, finish, hops, nodes, eids.

    No edge repeats within a trail (nodes may), so parallel edges give paths of their own
    and an undirected step never goes back over its edge.  Every level is one equi-join;
    ``ends`` (a frame of ids) filters finishes by a semi join.
    """
    step = steps(edges, direction, types).select("eid", "src", "dst")
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("finish"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("eids"))
    levels = [now.withColumn("hops", F.lit(0))] if least == 0 else []
    for n in range(1, most + 1):
        grown = now.join(step, F.col("finish") == F.col("src")).filter(~F.array_contains("eids", F.col("eid")))
        now = grown.select("start", F.col("dst").alias("finish"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("eids", F.col("eid")).alias("eids"))
        if n >= least:
            levels.append(now.withColumn("hops", F.lit(n)))
    out = reduce(DataFrame.unionByName, levels)
    if ends is not None:
        out = out.join(ends.select(F.col("id").alias("__end")).distinct(), F.col("finish") == F.col("__end"), "left_semi")
    return out


def typed_paths(starts: DataFrame, label: str, edges: dict[str, tuple[str, str, DataFrame]], least: int, most: int, end: str | None = None, pairs: bool = False) -> DataFrame:
    """Directed trails of ``least`` to ``most`` edges from nodes of one label: start, finish, hops.

    ``edges`` gives for each type the labels at its two ends and its frame (src, dst, and eid if a path can hold the type
    twice).  Only sequences of types that the labels allow, and that reach label ``end`` if it is given, are joined, each
    from the starts on; ``pairs`` wants pairs of ends only, so that each step may forget repeats.
    """
    out = []
    forget = pairs and not any(_leads(b, a, most, edges) for a, b, _ in edges.values())  # where a type can repeat, each trail counts

    def grow(rows: DataFrame, at: str, used: tuple[str, ...]) -> None:
        n = len(used)
        if n >= least and end in (None, at):
            out.append(rows.select("start", "finish", F.lit(n).alias("hops")))
        if n == most:
            return
        for kind, (a, b, frame) in edges.items():
            if a != at or (end is not None and not _leads(b, end, most - n - 1, edges)):
                continue
            again = kind in used
            step = frame.select(F.col("src").alias("finish"), F.col("dst").alias("next"), *([F.col("eid").alias("eid_")] if "eid" in frame.columns else []))
            grown = rows.join(step, "finish")
            if again:
                grown = grown.filter(~F.array_contains("eids", F.col("eid_")))
            eids = [F.array_append("eids", F.col("eid_")).alias("eids")] if "eid_" in grown.columns else ["eids"]
            grown = grown.select("start", F.col("next").alias("finish"), *eids)
            grow(grown.dropDuplicates(["start", "finish"]) if forget else grown, b, (*used, kind))

    grow(starts.select(F.col("id").alias("start"), F.col("id").alias("finish"), F.array().cast("array<string>").alias("eids")), label, ())
    return reduce(DataFrame.unionByName, out) if out else starts.select(F.col("id").alias("start"), F.col("id").alias("finish"), F.lit(0).alias("hops")).limit(0)


def pairs_between(starts: DataFrame, chain: list[DataFrame], ends: DataFrame | None = None) -> DataFrame:
    """Distinct (start, finish) joined by one edge of each frame of ``chain`` (src, dst) in turn; ``starts`` and ``ends`` are frames of ids.

    Frontiers, which are sets of nodes, go forward through the chain and prune each frame before the next is touched; from the
    ends, where they are given, they come back and prune again.  Then pairs grow from both sides over what is left and meet in the middle, so no partial
    path is ever joined that does not lead from a start to an end.  Repeated edges need not be removed before.
    """
    if not chain:
        same = starts.select(F.col("id").alias("start"), F.col("id").alias("finish")).distinct()
        return same if ends is None else same.join(ends.select(F.col("id").alias("finish")), "finish", "left_semi").select("start", "finish")
    front, pruned = starts.select(F.col("id").alias("src")).distinct(), []
    for e in chain:
        pruned.append(e.select("src", "dst").join(front, "src", "left_semi"))
        front = pruned[-1].select(F.col("dst").alias("src")).distinct()
    if ends is not None:
        back = ends.select(F.col("id").alias("dst")).distinct()
        for k in reversed(range(len(chain))):
            pruned[k] = pruned[k].join(back, "dst", "left_semi")
            back = pruned[k].select(F.col("src").alias("dst")).distinct()
    middle = (len(chain) + 1) // 2
    ahead = pruned[0].select(F.col("src").alias("start"), F.col("dst").alias("at"))
    for e in pruned[1:middle]:
        ahead = ahead.join(e.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").select("start", F.col("next").alias("at"))
    if middle == len(chain):
        return ahead.select("start", F.col("at").alias("finish")).distinct()
    behind = pruned[-1].select(F.col("src").alias("at"), F.col("dst").alias("finish")).distinct()
    for e in reversed(pruned[middle:-1]):
        behind = behind.join(e.select(F.col("src").alias("before"), F.col("dst").alias("at")), "at").select(F.col("before").alias("at"), "finish").distinct()
    return ahead.distinct().join(behind, "at").select("start", "finish").distinct()


def _leads(label: str, end: str, steps_left: int, edges: dict[str, tuple[str, str, DataFrame]]) -> bool:
    """Whether a path of so many steps at most can lead from one label to the other."""
    return label == end or (steps_left > 0 and any(a == label and _leads(b, end, steps_left - 1, edges) for a, b, _ in edges.values()))


def reachable(starts: DataFrame, edges: DataFrame, direction: str = "out", types: list[str] | None = None, max_rounds: int = 1000) -> DataFrame:
    """(start, finish, hops) for all nodes reachable by one or more edges, with the fewest hops.

    A loop over frontiers with an anti join against what was seen; it ends on cyclic graphs.
    Each frontier is a table in the shared folder, written once; together they are what was seen.
    """
    step = steps(edges, direction, types).select("src", "dst").distinct()
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("finish")).distinct()
    seen = None
    for n in range(1, max_rounds + 1):
        grown = front.join(step, F.col("finish") == F.col("src")).select("start", F.col("dst").alias("finish")).distinct()
        if seen is not None:
            grown = grown.join(seen.select("start", "finish"), ["start", "finish"], "left_anti")
        front = durable(grown.withColumn("hops", F.lit(n)), "front")
        seen = front if seen is None else seen.unionByName(front)
        if front.isEmpty():
            return seen
        front = front.select("start", "finish")
    raise RuntimeError(f"not settled after {max_rounds} rounds")


def climb(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """id, root and depth of every node of a forest whose edges lead from a node (src) to its one parent (dst).

    Pointer doubling: after round k a node knows its 2^k-th ancestor, so a chain of n nodes takes log2(n) + 1 rounds, each one
    equi-join.  Nodes that have reached their root take no further part.  Nodes on a cycle or below one never do; they are told by the number
    of rounds, which then passes the logarithm of the number of nodes, and have a null root and depth.  Repeated edges count once; a node
    with two different parents is refused.
    """
    pairs = edges.filter("src is not null and dst is not null").select(F.col("src").alias("id"), F.col("dst").alias("at"))
    kept = Generations(edges.sparkSession, "climb")
    parents = kept.put(pairs.groupBy("id").agg(F.min("at").alias("at"), F.max("at").alias("other")))
    if not parents.filter("at <> other").isEmpty():
        raise ValueError("a node has two parents; climb() follows one")
    roots = parents.select(F.col("at").alias("id")).join(parents.select("id"), "id", "left_anti").distinct()
    top = roots.select(F.col("id").alias("r"))
    started = parents.select("id", "at", F.lit(1).cast("bigint").alias("depth")).join(top, F.col("at") == F.col("r"), "left")
    jumps = kept.put(started.select("id", "at", "depth", F.col("r").isNotNull().alias("done")).unionByName(roots.select("id", F.col("id").alias("at"), F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("done"))))
    nodes = jumps.count()
    for n in range(max_rounds):
        if jumps.filter("not done").isEmpty() or 2**n > 2 * nodes:
            break
        further = jumps.select(F.col("id").alias("at"), F.col("at").alias("up"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        moved = jumps.filter("not done").join(further, "at").select("id", F.col("up").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        jumps = kept.put(jumps.filter("done").unionByName(moved))
    return jumps.select("id", F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def ancestors(edges: DataFrame, types: list[str] | None = None, max_rounds: int = 1000) -> DataFrame:
    """id and its number of distinct ancestors along incoming edges; where no node has two parents or a cycle above it, that is its depth, by doubling."""
    up = steps(edges, "in", types).select("src", "dst").filter("src <> dst").distinct()
    if up.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        depths = climb(up, max_rounds)
        if depths.filter("depth is null").isEmpty():
            return depths.filter("depth > 0").select("id", "depth")
    ids = edges.select(F.col("dst").alias("id")).distinct()
    return reachable(ids, edges, "in", types, max_rounds).groupBy(F.col("start").alias("id")).agg(F.count("*").alias("depth"))


def prefix_tree(paths_: DataFrame, path: str, max_depth: int | None = None) -> DataFrame:
    """Distinct (parent, child, depth) over the prefixes of slash-separated paths; the root is ''."""
    parts = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    deep = F.size("parts") if max_depth is None else F.least(F.size("parts"), F.lit(max_depth))
    each = paths_.select(parts.alias("parts")).filter(F.size("parts") > 0).select("parts", F.explode(F.sequence(F.lit(1), deep)).alias("depth"))
    prefix = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    return each.select(F.when(F.col("depth") > 1, prefix(F.col("depth") - 1)).otherwise("").alias("parent"), prefix(F.col("depth")).alias("child"), "depth").distinct()
