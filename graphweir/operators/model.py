"""The labelled property graph as typed frames, and its mapping onto relational tables.

Nodes are (id, label, name), edges (eid, src, dst, type).  Only the labels and types that a
query names are read, so a pattern scans the two columns of the tables it touches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweir.plans.session import table

#: label -> table, key column, name column
LABELS = {
    "Region": ("region", "r_regionkey", "r_name"),
    "Nation": ("nation", "n_nationkey", "n_name"),
    "Customer": ("customer", "c_custkey", "c_name"),
    "Supplier": ("supplier", "s_suppkey", "s_name"),
    "Part": ("part", "p_partkey", "p_name"),
    "Order": ("orders", "o_orderkey", "o_orderstatus"),
}
#: type -> table, source label and column, target label and column
EDGES = {
    "IN_REGION": ("nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
    "LIVES_IN": ("customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    "BASED_IN": ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
    "PLACED": ("orders", "Customer", "o_custkey", "Order", "o_orderkey"),
    "CONTAINS": ("lineitem", "Order", "l_orderkey", "Part", "l_partkey"),
    "SUPPLIED_BY": ("lineitem", "Part", "l_partkey", "Supplier", "l_suppkey"),
}


def node_id(label: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(label.lower() + ":"), key.cast("string"))


def nodes(spark: SparkSession, sf_dir: str, *labels: str) -> DataFrame:
    """id, label, name of the nodes with the given labels (all, if none is given)."""
    parts = []
    for label in labels or LABELS:
        name, key, text = LABELS[label]
        parts.append(table(spark, sf_dir, name).select(node_id(label, key).alias("id"), F.lit(label).alias("label"), F.col(text).alias("name")))
    return reduce(DataFrame.unionByName, parts)


def node_by_id(spark: SparkSession, sf_dir: str, node: str) -> DataFrame:
    """id, label, name of the node with this id: its label picks the table, its key is a filter that reaches the scan."""
    kind, _, key = node.partition(":")
    label = next((x for x in LABELS if x.lower() == kind), None)
    if label is None or not (key.isascii() and key.isdigit()) or str(int(key)) != key:
        return nodes(spark, sf_dir, "Region").limit(0)
    name, column, text = LABELS[label]
    found = table(spark, sf_dir, name).filter(F.col(column) == int(key))
    return found.select(node_id(label, column).alias("id"), F.lit(label).alias("label"), F.col(text).alias("name"))


def key_edges(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """src, dst of one type as the tables' own keys, repeats and all: for joins that shuffle numbers instead of ids and forget repeats later."""
    name, _, a, _, b = EDGES[kind]
    return table(spark, sf_dir, name).select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src is not null and dst is not null")


def edges(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """eid, src, dst, type of the edges with the given types (all, if none is given)."""
    parts = []
    for kind in types or EDGES:
        name, a, a_key, b, b_key = EDGES[kind]
        pairs = table(spark, sf_dir, name).select(F.col(a_key).alias("a"), F.col(b_key).alias("b")).filter("a is not null and b is not null")
        if name == "lineitem":
            pairs = pairs.distinct()  # one edge for each pair, however many lines
        src, dst = node_id(a, "a"), node_id(b, "b")
        parts.append(pairs.select(F.concat(F.lit(kind + ":"), src, F.lit(">"), dst).alias("eid"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type")))
    return reduce(DataFrame.unionByName, parts)


def typed_edges(spark: SparkSession, sf_dir: str, *types: str) -> dict[str, tuple[str, str, DataFrame]]:
    """For each type the labels at its ends, and its edges."""
    return {t: (EDGES[t][1], EDGES[t][3], edges(spark, sf_dir, t).drop("type")) for t in types or EDGES}


def nodes_sql(*labels: str) -> str:
    """The same nodes for DuckDB."""
    return " UNION ALL ".join(f"SELECT '{x.lower()}:' || {LABELS[x][1]} AS id, '{x}' AS label, {LABELS[x][2]} AS name FROM {LABELS[x][0]}" for x in labels or LABELS)


def edges_sql(*types: str) -> str:
    """The same edges for DuckDB."""
    out = []
    for kind in types or EDGES:
        t, a, ak, b, bk = EDGES[kind]
        src, dst = f"'{a.lower()}:' || {ak}", f"'{b.lower()}:' || {bk}"
        out.append(f"SELECT DISTINCT '{kind}:' || {src} || '>' || {dst} AS eid, {src} AS src, {dst} AS dst, '{kind}' AS type FROM {t}")
    return " UNION ALL ".join(out)


def surrogate_ids(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds a key for tables without one: a hash of the whole row, and a rank among exact copies."""
    h = F.xxhash64(*rows.columns)
    ranked = rows.withColumn("__h", h).withColumn("__r", F.row_number().over(Window.partitionBy("__h", *rows.columns).orderBy("__h")))
    return ranked.withColumn(name, F.concat_ws("-", F.hex("__h"), "__r")).drop("__h", "__r")


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected steps: every edge and its reverse, under the same eid."""
    back = edges.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return edges.unionByName(back.filter("src <> dst"))


def steps(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """The edges as steps from ``src`` to ``dst`` in the asked direction."""
    if types:
        edges = edges.filter(F.col("type").isin(types))
    if direction == "any":
        return both_ways(edges)
    if direction == "in":
        return edges.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return edges


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that break a uniqueness constraint, with how often they occur; nulls do not count."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return rows.filter(present).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_properties(rows: DataFrame, key: str, *required: str) -> DataFrame:
    """``key`` and property for each required property that a row lacks: an existence constraint as a query for its violations."""
    lacking = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in required]), lambda c: c.isNotNull())
    return rows.select(key, F.explode(lacking).alias("property"))
