"""Joins, patterns, path expansion, set operations and mutations on the property graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphweir.operators import expand, mutations, patterns
from graphweir.operators.model import edges, edges_sql, key_edges, node_by_id, node_id, nodes, nodes_sql, surrogate_ids, typed_edges
from graphweir.plans.durable import shared_dir
from graphweir.plans.keyed import KeyedTable
from graphweir.plans.session import table
from graphweir.registry import query

PLACED, LIVES, CONTAINS, SUPPLIED = (edges_sql(t) for t in ("PLACED", "LIVES_IN", "CONTAINS", "SUPPLIED_BY"))
PLACES = edges_sql("IN_REGION", "LIVES_IN", "BASED_IN")


@query("j1", f"WITH e AS ({PLACED}) SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c JOIN e ON e.src = 'customer:' || c.c_custkey JOIN orders o ON e.dst = 'order:' || o.o_orderkey")
def j1(spark, d):
    """Single hop: customers and the orders they placed."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", node_id("Customer", "c_custkey").alias("c"))
    found = patterns.hop(rows, "c", edges(spark, d, "PLACED"), "o")
    orders = table(spark, d, "orders").select(node_id("Order", "o_orderkey").alias("o"), "o_orderkey")
    return found.join(orders, "o").select("c_custkey", "c_name", "o_orderkey")


@query("j2", f"WITH e AS ({CONTAINS}) SELECT o_custkey, o_orderkey, e.dst AS part FROM orders JOIN e ON e.src = 'order:' || o_orderkey")
def j2(spark, d):
    """Fixed chain: customer, order, part."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", node_id("Order", "o_orderkey").alias("o"))
    return patterns.hop(orders, "o", edges(spark, d, "CONTAINS"), "part").select("o_custkey", "o_orderkey", "part")


@query("j3", "SELECT c_custkey, o_orderkey::VARCHAR AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'")
def j3(spark, d):
    """Optional match whose condition belongs to the match."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").cast("string").alias("o_orderkey"))


@query("j4", "SELECT r_name, n_name, c_name, o_orderkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey")
def j4(spark, d):
    """Chained optional hops, three deep from a root."""
    ids = table(spark, d, "region").select("r_name", node_id("Region", "r_regionkey").alias("r"))
    one = patterns.hop(ids, "r", edges(spark, d, "IN_REGION"), "n", direction="in", optional=True)
    two = patterns.hop(one, "n", edges(spark, d, "LIVES_IN"), "c", direction="in", optional=True)
    named = patterns.attach(patterns.attach(two, "n", nodes(spark, d, "Nation"), "n_", True), "c", nodes(spark, d, "Customer"), "c_", True)
    three = patterns.hop(named, "c", edges(spark, d, "PLACED"), "o", optional=True)
    return three.select("r_name", "n_name", "c_name", F.substring_index("o", ":", -1).cast("bigint").alias("o_orderkey"))


@query("j5", "SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def j5(spark, d):
    """A hop against the edge's direction."""
    found = patterns.hop(nodes(spark, d, "Nation").withColumnRenamed("name", "n_name"), "id", edges(spark, d, "BASED_IN"), "s", direction="in")
    return patterns.attach(found, "s", nodes(spark, d, "Supplier"), "s_").select("n_name", "s_name")


@query("j6", f"WITH e AS ({PLACES}), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT n.id, u.dst AS other FROM ({nodes_sql('Nation')}) n JOIN u ON u.src = n.id")
def j6(spark, d):
    """Undirected hop."""
    return patterns.hop(nodes(spark, d, "Nation"), "id", edges(spark, d, "IN_REGION", "LIVES_IN", "BASED_IN"), "other", direction="any").select("id", "other")


@query("j7", "SELECT DISTINCT s1.s_suppkey AS a, s2.s_suppkey AS b FROM lineitem s1 JOIN lineitem s2 ON s1.l_partkey = s2.l_partkey AND s1.l_orderkey = s2.l_orderkey JOIN supplier x ON x.s_suppkey = s1.l_suppkey".replace("s1.s_suppkey", "s1.l_suppkey").replace("s2.s_suppkey", "s2.l_suppkey"))
def j7(spark, d):
    """Cyclic pattern: suppliers that meet in the same part of the same order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    left = li.withColumnRenamed("l_suppkey", "a").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("a")), "a")
    return left.join(li.withColumnRenamed("l_suppkey", "b"), ["l_orderkey", "l_partkey"]).select("a", "b").distinct()


@query("j8", "SELECT DISTINCT o_orderkey, s_suppkey, n_nationkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey AND n_nationkey = c_nationkey")
def j8(spark, d):
    """Diamond: an order whose customer and supplier meet in the same nation."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    s = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_suppkey", "s_nationkey")
    met = o.join(s, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return met.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("o_orderkey", "s_suppkey", "n_nationkey").distinct()


@query("j9", f"WITH e AS ({PLACES}) SELECT src, dst, type FROM e WHERE type IN ('LIVES_IN', 'BASED_IN')")
def j9(spark, d):
    """Alternation of relationship types."""
    all_ = edges(spark, d, "IN_REGION", "LIVES_IN", "BASED_IN")
    return all_.filter(F.col("type").isin("LIVES_IN", "BASED_IN")).select("src", "dst", "type")


@query("j10", f"WITH e AS ({PLACES}) SELECT n.name, e.type, count(*) AS n FROM ({nodes_sql('Nation')}) n JOIN (SELECT src AS id, type FROM e UNION ALL SELECT dst, type FROM e) e ON e.id = n.id GROUP BY 1, 2")
def j10(spark, d):
    """Any-type hop, counted by type."""
    found = patterns.hop(nodes(spark, d, "Nation"), "id", edges(spark, d, "IN_REGION", "LIVES_IN", "BASED_IN"), "x", direction="any")
    return found.groupBy("name", F.col("x_type").alias("type")).agg(F.count("*").alias("n"))


@query("j11", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j11(spark, d):
    """Semi join: customers with an order."""
    rows = table(spark, d, "customer").select("c_custkey", node_id("Customer", "c_custkey").alias("c"))
    return patterns.having(rows, "c", edges(spark, d, "PLACED")).select("c_custkey")


@query("j12", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j12(spark, d):
    """Anti join: orders without lines."""
    rows = table(spark, d, "orders").select("o_orderkey", node_id("Order", "o_orderkey").alias("o"))
    return patterns.having(rows, "o", edges(spark, d, "CONTAINS"), negate=True).select("o_orderkey")


@query("j13", "SELECT 'region:0' AS src, 'nation:0' AS dst, 'MANUAL' AS type FROM region JOIN nation ON r_regionkey = 0 AND n_nationkey = 0")
def j13(spark, d):
    """Link two nodes given by id, if both exist."""
    a = node_by_id(spark, d, "region:0").select(F.col("id").alias("src"), F.lit(1).alias("k"))
    b = node_by_id(spark, d, "nation:0").select(F.col("id").alias("dst"), F.lit(1).alias("k"))
    return a.join(b, "k").select("src", "dst", F.lit("MANUAL").alias("type"))


@query("j14", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def j14(spark, d):
    """Disconnected patterns, scoped to their root: each branch is counted apart."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    n = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("k")).join(c, "k", "left").join(s, "k", "left")
    return n.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("j15", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON substr(c_name, 10) = substr(s_name, 10)")
def j15(spark, d):
    """Value join on a string property."""
    c = table(spark, d, "customer").select("c_custkey", F.expr("substr(c_name, 10)").alias("k"))
    return c.join(table(spark, d, "supplier").select("s_suppkey", F.expr("substr(s_name, 10)").alias("k")), "k").select("c_custkey", "s_suppkey")


PATHS = "SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '/$', '') AS path, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages"


@query("j17", f"""WITH p AS ({PATHS}), q AS (SELECT page_id, host || '/' || path AS full, path, regexp_extract(path, '[^/]*$') AS base FROM p)
SELECT a.page_id AS node_id, min(b.full) AS file_path FROM q a JOIN q b ON a.path = b.path WHERE a.path <> '' GROUP BY 1""")
def j17(spark, d):
    """Ranked path matching: each page path to the file with the longest matching suffix."""
    p = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "/$", "").alias("path"), F.regexp_extract("url", "://([^/]+)", 1).alias("host")).filter("path <> ''")
    full = p.select(F.col("page_id").alias("file_id"), F.concat_ws("/", "host", "path").alias("path"))
    return patterns.match_paths(p.select(F.col("page_id").alias("node_id"), "path"), full).select("node_id", "file_path")


@query("j18", """WITH s AS (SELECT source, contains(lower(text), 'password') AS a, contains(lower(text), 'license') AS b FROM documents)
SELECT source, count(*) FILTER (WHERE a) AS n_sources, count(*) FILTER (WHERE b) AS n_sinks, (count(*) FILTER (WHERE a)) * (count(*) FILTER (WHERE b)) - count(*) FILTER (WHERE a AND b) AS n_pairs FROM s GROUP BY 1 HAVING n_sources > 0 AND n_sinks > 0""")
def j18(spark, d):
    """Sources and sinks that share a file: counted per file, so that the pairs are never made."""
    t = F.lower("text")
    docs = table(spark, d, "documents").select("source", F.contains(t, F.lit("password")).alias("a"), F.contains(t, F.lit("license")).alias("b"))
    per = docs.groupBy("source").agg(F.count_if("a").alias("n_sources"), F.count_if("b").alias("n_sinks"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    return per.filter("n_sources > 0 and n_sinks > 0").select("source", "n_sources", "n_sinks", (F.col("n_sources") * F.col("n_sinks") - F.col("both")).alias("n_pairs"))


@query("j20", "SELECT DISTINCT c_custkey, l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal < 0 AND l_returnflag = 'R'")
def j20(spark, d):
    """Source and sink pairs with a path between them, found from both ends."""
    sources = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    found = expand.pairs_between(sources, [key_edges(spark, d, "PLACED"), returned])
    return found.select(F.col("start").alias("c_custkey"), F.col("finish").alias("l_partkey"))


@query("j22", "SELECT o_orderkey, o_orderpriority, weight FROM orders JOIN (VALUES ('1-URGENT', 10), ('2-HIGH', 7), ('3-MEDIUM', 4)) w(p, weight) ON p = o_orderpriority")
def j22(spark, d):
    """Lookup join that drops rows with an unknown requirement."""
    dim = spark.createDataFrame([("1-URGENT", 10), ("2-HIGH", 7), ("3-MEDIUM", 4)], "p string, weight int")
    return table(spark, d, "orders").join(dim, F.col("o_orderpriority") == F.col("p")).select("o_orderkey", "o_orderpriority", "weight")


@query("j25", "SELECT c_custkey, coalesce(bool_or(o_totalprice > 400000), false) AS allowed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j25(spark, d):
    """Any role grants."""
    grants = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 400000).alias("g"))
    c = table(spark, d, "customer").join(grants, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("g", F.lit(False)).alias("allowed"))


@query("j26", f"WITH p AS (SELECT DISTINCT path FROM ({PATHS}) WHERE path <> '') SELECT a.path, coalesce(b.path, '') AS parent FROM p a LEFT JOIN p b ON b.path = regexp_replace(a.path, '/?[^/]*$', '')")
def j26(spark, d):
    """Nearest parent by directory name, orphans to the root."""
    p = table(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "/$", "").alias("path")).filter("path <> ''").distinct()
    parent = p.select(F.col("path").alias("parent"))
    return p.join(parent, F.regexp_replace("path", "/?[^/]*$", "") == F.col("parent"), "left").select("path", F.coalesce("parent", F.lit("")).alias("parent"))


U_PLACES = f"e AS ({PLACES}), u AS (SELECT eid, src, dst FROM e UNION ALL SELECT eid, dst, src FROM e)"
TRAILS = f"""WITH {U_PLACES}, p1 AS (SELECT src AS start, dst AS finish, eid AS a FROM u WHERE src LIKE 'region:%'),
p2 AS (SELECT start, u.dst AS finish, a, eid AS b FROM p1 JOIN u ON u.src = finish WHERE eid <> a),
p3 AS (SELECT start, u.dst AS finish FROM p2 JOIN u ON u.src = finish WHERE eid <> a AND eid <> b),
p AS (SELECT start, finish, 1 AS hops FROM p1 UNION ALL SELECT start, finish, 2 FROM p2 UNION ALL SELECT start, finish, 3 FROM p3)"""


@query("g1", TRAILS + " SELECT start, finish, hops FROM p WHERE finish LIKE 'supplier:%'")
def g1(spark, d):
    """Undirected trails of one to three edges from a region to a supplier, a row per path."""
    found = expand.paths(nodes(spark, d, "Region").select("id"), edges(spark, d, "IN_REGION", "LIVES_IN", "BASED_IN"), 1, 3, "any", ends=nodes(spark, d, "Supplier"))
    return found.select("start", "finish", "hops")


@query("g2", TRAILS + " SELECT start, count(*) AS n_paths, count(DISTINCT finish) AS n_nodes FROM p WHERE finish LIKE 'supplier:%' GROUP BY 1")
def g2(spark, d):
    """The same, counted: paths, and distinct nodes."""
    return g1(spark, d).groupBy("start").agg(F.count("*").alias("n_paths"), F.count_distinct("finish").alias("n_nodes"))


CHAIN = edges_sql("PLACED", "CONTAINS", "SUPPLIED_BY")


@query("g3", "SELECT 'customer:' || c AS start, hops, n FROM (SELECT o_custkey AS c, 1 AS hops, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 2, count(*) FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1)")
def g3(spark, d):
    """Directed typed paths of one to two edges, counted by start and length."""
    found = expand.typed_paths(nodes(spark, d, "Customer").select("id"), "Customer", typed_edges(spark, d, "PLACED", "CONTAINS"), 1, 2)
    return found.groupBy("start", "hops").agg(F.count("*").alias("n"))


@query("g4", "SELECT 'region:' || n_regionkey AS start, 'customer:' || c_custkey AS finish FROM nation JOIN customer ON c_nationkey = n_nationkey")
def g4(spark, d):
    """Unbounded containment from a root down to the leaves of one label, found from the leaves up."""
    tops = expand.climb(edges(spark, d, "IN_REGION", "LIVES_IN")).join(nodes(spark, d, "Customer").select("id"), "id", "left_semi")
    return tops.join(nodes(spark, d, "Region").select(F.col("id").alias("root")), "root", "left_semi").select(F.col("root").alias("start"), F.col("id").alias("finish"))


@query("g5", "SELECT 'customer:' || c_custkey AS start, 'region:' || n_regionkey AS finish FROM nation JOIN customer ON c_nationkey = n_nationkey")
def g5(spark, d):
    """Unbounded PART_OF up to the root, by pointer doubling."""
    tops = expand.climb(edges(spark, d, "IN_REGION", "LIVES_IN"))
    return tops.filter(F.startswith("id", F.lit("customer:")) & F.startswith("root", F.lit("region:"))).select(F.col("id").alias("start"), F.col("root").alias("finish"))


@query("g6", "SELECT 'region:' || n_regionkey || '/nation:' || n_nationkey || '/customer:' || c_custkey AS path FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 'region:' || n_regionkey || '/nation:' || n_nationkey FROM nation")
def g6(spark, d):
    """Bounded containment with whole paths."""
    found = expand.paths(nodes(spark, d, "Region").select("id"), edges(spark, d, "IN_REGION", "LIVES_IN"), 1, 3, "in")
    return found.select(F.array_join("nodes", "/").alias("path"))


@query("g7", "SELECT 'customer:' || c_custkey AS id, 2::BIGINT AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation")
def g7(spark, d):
    """Depth as the number of ancestors, at most three."""
    tree = edges(spark, d, "IN_REGION", "LIVES_IN").select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return expand.ancestors(tree).filter("depth <= 3")


@query("g8", "SELECT DISTINCT 'customer:' || o_custkey AS source, 'supplier:' || l_suppkey AS sink, 'medium' AS impact, 0.6::DOUBLE AS confidence FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) x ON x.p = l.l_partkey WHERE c_acctbal < -900".replace("'supplier:' || l_suppkey", "'supplier:' || x.s"))
def g8(spark, d):
    """Source-to-sink paths of up to three calls, one row per pair: along PLACED, CONTAINS and SUPPLIED_BY, the only way that the labels allow."""
    sources = table(spark, d, "customer").filter("c_acctbal < -900").select(F.col("c_custkey").alias("id"))
    found = expand.pairs_between(sources, [key_edges(spark, d, t) for t in ("PLACED", "CONTAINS", "SUPPLIED_BY")])
    pairs = found.select(node_id("Customer", "start").alias("source"), node_id("Supplier", "finish").alias("sink"))
    return pairs.withColumn("impact", F.lit("medium")).withColumn("confidence", F.lit(0.6))


@query("g9", "SELECT n_id AS node, min('region:' || n_regionkey) OVER (PARTITION BY n_regionkey) AS root FROM (SELECT 'nation:' || n_nationkey AS n_id, n_regionkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def g9(spark, d):
    """Connected components; the root is the region that the component holds."""
    e = edges(spark, d, "IN_REGION", "BASED_IN")
    comp = expand.connected_components(e, "src", "dst")
    root = comp.filter(F.startswith("node", F.lit("region:"))).groupBy("component").agg(F.min("node").alias("root"))
    return comp.filter(~F.startswith("node", F.lit("region:"))).join(root, "component").select("node", "root")


@query("g10", f"WITH p AS (SELECT DISTINCT string_split(path, '/') AS x FROM ({PATHS}) WHERE path <> '') SELECT DISTINCT array_to_string(x[1:i - 1], '/') AS parent, array_to_string(x[1:i], '/') AS child, i::INT AS depth FROM (SELECT list_filter(x, lambda s: s <> '') AS x FROM p), range(1, 4) r(i) WHERE i <= len(x)")
def g10(spark, d):
    """Path-prefix tree, at most three deep."""
    p = table(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "/$", "").alias("path")).filter("path <> ''")
    return expand.prefix_tree(p, "path", 3)


@query("g11", f"WITH {U_PLACES} SELECT DISTINCT dst AS id FROM u WHERE src = 'nation:3'")
def g11(spark, d):
    """Neighbours of the selected node."""
    one = node_by_id(spark, d, "nation:3").select("id")
    return patterns.hop(one, "id", edges(spark, d, "IN_REGION", "LIVES_IN", "BASED_IN"), "x", direction="any").select(F.col("x").alias("id")).distinct()


@query("u1", "SELECT c_nationkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def u1(spark, d):
    """Bag union of two funnels."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("kind")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("kind")))


@query("u2", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.08")
def u2(spark, d):
    """Bag union of two analyzers' paths; repeats stay."""
    li = table(spark, d, "lineitem")
    return li.filter("l_quantity > 45").select("l_orderkey", "l_partkey").unionByName(li.filter("l_discount > 0.08").select("l_orderkey", "l_partkey"))


@query("u3", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def u3(spark, d):
    """First occurrence of each node."""
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("u4", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def u4(spark, d):
    """Links whose two ends are both present."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    li = table(spark, d, "lineitem").filter("l_returnflag = 'A'")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("u5", "SELECT DISTINCT p_brand, p_type FROM part")
def u5(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("u6", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def u6(spark, d):
    """Pairs in one relation and not in the other."""
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey").subtract(li.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@query("u7", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def u7(spark, d):
    """Pairs in both relations."""
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey").intersect(li.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@query("u8", "SELECT count(*) AS n_edges FROM (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag IN ('A', 'R')) WHERE true")
def u8(spark, d):
    """Repair: relation A gains the pairs that only relation R has."""
    li = table(spark, d, "lineitem")

    def pairs(flag):
        return li.filter(F.col("l_returnflag") == flag).select(node_id("Part", "l_partkey").alias("src"), node_id("Supplier", "l_suppkey").alias("dst"), F.lit("SUPPLIED_BY").alias("type")).distinct()

    return mutations.merge_edges(pairs("A"), pairs("R")).agg(F.count("*").alias("n_edges"))


@query("u9", "SELECT DISTINCT event_type FROM events")
def u9(spark, d):
    return table(spark, d, "events").select("event_type").distinct().orderBy("event_type")


@query("w1", "SELECT 'node-' || r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT 'node-new', 'ATLANTIS'")
def w1(spark, d):
    """Create a node: append with an id derived from its key."""
    old = table(spark, d, "region").select(F.concat(F.lit("node-"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("name"))
    new = spark.createDataFrame([("node-new", "ATLANTIS")], "key string, name string").withColumn("id", mutations.stable_id(F.col("key")))
    return old.unionByName(new.select("key", "name"))


@query("w2", "SELECT c_custkey, c_name, CASE WHEN o_custkey IS NOT NULL THEN 'ACTIVE' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey")
def w2(spark, d):
    """Upsert into a stored table: customers with orders become ACTIVE, unknown ones would be added; partitions without changes stay."""
    stored = KeyedTable(spark, f"{shared_dir(spark)}/graphweir/customers-{uuid.uuid4().hex}", ["c_custkey"], 8)
    stored.create(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    stored.merge(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("c_mktsegment", F.lit("ACTIVE")))
    return stored.read()


@query("w3", "SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_partkey)) AS pairs FROM lineitem")
def w3(spark, d):
    """Create relationships without dedup; each gets an id of its own."""
    rows = surrogate_ids(table(spark, d, "lineitem"), "eid")
    return rows.agg(F.count_distinct("eid").alias("n"), F.count_distinct("l_orderkey", "l_partkey").alias("pairs"))


@query("w4", "SELECT 2 * count(DISTINCT (l_orderkey, l_partkey)) AS n FROM lineitem")
def w4(spark, d):
    """Merge an edge pair (both directions); repeats count once."""
    e = table(spark, d, "lineitem").select(node_id("Part", "l_partkey").alias("src"), node_id("Order", "l_orderkey").alias("dst"), F.lit("PART_OF").alias("type"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("DEFINES").alias("type"))
    return mutations.merge_edges(e.limit(0), e.unionByName(back)).agg(F.count("*").alias("n"))


@query("w5", "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'error' THEN 'yes' ELSE 'no' END AS failed FROM events")
def w5(spark, d):
    """Property update: new entries join the map and win."""
    props = mutations.set_properties(F.from_json("props", "map<string,string>"), F.create_map(F.lit("failed"), F.when(F.col("event_type") == "error", "yes").otherwise("no")))
    e = table(spark, d, "events").select("event_id", props.alias("p"))
    return e.select("event_id", F.col("p")["k"].alias("k"), F.col("p")["failed"].alias("failed"))


@query("w6", f"WITH e AS ({PLACES}) SELECT count(*) AS n_edges FROM e WHERE src <> 'nation:3' AND dst <> 'nation:3'")
def w6(spark, d):
    """Detach-delete of one node."""
    n, e = nodes(spark, d, "Region", "Nation", "Customer", "Supplier"), edges(spark, d, "IN_REGION", "LIVES_IN", "BASED_IN")
    _, left = mutations.detach_delete(n, e, n.filter("id = 'nation:3'"))
    return left.agg(F.count("*").alias("n_edges"))


@query("w7", f"WITH {U_PLACES}, h AS (SELECT 'nation:3' AS id UNION SELECT dst FROM u WHERE src = 'nation:3' UNION SELECT b.dst FROM u a JOIN u b ON b.src = a.dst AND a.eid <> b.eid WHERE a.src = 'nation:3') SELECT n.id FROM ({nodes_sql('Region', 'Nation', 'Customer', 'Supplier')}) n WHERE n.id NOT IN (SELECT id FROM h)")
def w7(spark, d):
    """Delete a node with its neighbourhood of two hops."""
    n, e = nodes(spark, d, "Region", "Nation", "Customer", "Supplier"), edges(spark, d, "IN_REGION", "LIVES_IN", "BASED_IN")
    start = n.filter("id = 'nation:3'").select("id")
    near = expand.paths(start, e, 0, 2, "any").select(F.col("finish").alias("id"))
    return mutations.detach_delete(n, e, near)[0].select("id")


@query("w8", "SELECT 'customer:' || c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2")
def w8(spark, d):
    """Delete a whole component."""
    n, e = nodes(spark, d, "Region", "Nation", "Customer"), edges(spark, d, "IN_REGION", "LIVES_IN")
    comp = expand.connected_components(e, "src", "dst")
    one = comp.filter("node = 'region:2'").select("component")
    gone = comp.join(one, "component", "left_semi").select(F.col("node").alias("id"))
    return mutations.detach_delete(n, e, gone)[0].filter("label = 'Customer'").select("id")


@query("w9", "SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey <> 7")
def w9(spark, d):
    """Delete outgoing relations, then the node."""
    n, e = nodes(spark, d, "Nation"), edges(spark, d, "IN_REGION")
    return mutations.detach_delete(n, e.filter("src <> 'nation:7'"), n.filter("id = 'nation:7'"))[0].select("id")


@query("w10", "SELECT count(*) AS n FROM region WHERE false")
def w10(spark, d):
    """Clear all, behind a confirmation code."""
    return mutations.clear(table(spark, d, "region"), "CONFIRM").agg(F.count("*").alias("n"))


@query("w11", f"WITH p AS (SELECT DISTINCT host, path FROM ({PATHS}) WHERE path <> '') SELECT host || '/' || regexp_replace(path, '/?[^/]*$', '') AS parent, host || '/' || path AS child FROM p")
def w11(spark, d):
    """Filesystem graph: CONTAINS from the directory, or the repository where there is none."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("repo"), F.regexp_replace(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "/$", "").alias("path")).filter("path <> ''").distinct()
    parent = F.concat_ws("/", "repo", F.regexp_replace("path", "/?[^/]*$", ""))
    return p.select(parent.alias("parent"), F.concat_ws("/", "repo", "path").alias("child"))


@query("w12", "SELECT l_orderkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey")
def w12(spark, d):
    """Parser output remapped to graph ids; edges with an unmapped end are dropped."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return li.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "l_partkey")


@query("w21", "SELECT 'investigation-' || o_custkey AS src, 'finding-' || o_orderkey AS dst, 'HAS_FINDING' AS type FROM orders")
def w21(spark, d):
    """Created nodes hang below their owner by one edge each."""
    return table(spark, d, "orders").select(F.concat(F.lit("investigation-"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("finding-"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit("HAS_FINDING").alias("type"))
