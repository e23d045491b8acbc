"""Aggregations, sorts and limits, retrieval, audit, findings, funnels and composite reports."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphweir.functions import text as rules
from graphweir.operators import aggregates as agg
from graphweir.operators import audit, findings, funnels, patterns, vector, vector_index
from graphweir.operators.model import edges, edges_sql, nodes, nodes_sql
from graphweir.plans import retention
from graphweir.plans.durable import shared_dir
from graphweir.plans.observed import written
from graphweir.plans.session import table
from graphweir.queries.scans import any_sql, case_sql, count_sql
from graphweir.registry import query

PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low", "5-LOW": "info"}
SEV_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'info' END"
WEIGHT_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END"


def _findings(spark, d):
    return table(spark, d, "orders").withColumn("severity", rules.mapped(F.col("o_orderpriority"), PRIORITY, "info"))


def _n(name="n"):
    return F.count("*").alias(name)


@query("a1", "SELECT count(*) AS n FROM orders")
def a1(spark, d):
    return table(spark, d, "orders").agg(_n())


@query("a2", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a2(spark, d):
    """Count per left row, zero for none: counted before the join."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(_n())
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("a3", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def a3(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))


@query("a4", "SELECT l_returnflag, count(DISTINCT l_orderkey) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY 1")
def a4(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_orderkey"))).alias("n"))


@query("a5", "SELECT count(lang) AS with_lang, count(*) AS total FROM documents")
def a5(spark, d):
    return table(spark, d, "documents").agg(F.count("lang").alias("with_lang"), _n("total"))


@query("a6", f"SELECT label, count(*) AS n FROM ({nodes_sql()}) GROUP BY 1")
def a6(spark, d):
    return nodes(spark, d).groupBy("label").agg(_n()).orderBy(F.desc("n"), "label")


@query("a7", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def a7(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(_n()).filter("lang is not null").orderBy(F.desc("n"), "lang")


@query("a8", f"SELECT type, count(*) AS n FROM ({edges_sql()}) GROUP BY 1")
def a8(spark, d):
    return edges(spark, d).groupBy("type").agg(_n())


@query("a9", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY 1")
def a9(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("a10", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_nationkey || '>' || n_name)), ',') AS links FROM nation GROUP BY 1")
def a10(spark, d):
    pairs = F.transform(F.collect_set(F.struct("n_nationkey", "n_name")), lambda s: F.concat(s["n_nationkey"].cast("string"), F.lit(">"), s["n_name"]))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(pairs), ",").alias("links"))


@query("a11", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1")
def a11(spark, d):
    """Collected sets exploded again, then counted."""
    sets = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"))
    return sets.select(F.explode("s").alias("c_mktsegment")).groupBy("c_mktsegment").agg(_n())


@query("a12", f"SELECT v AS severity, count(o_orderkey) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info'), ('unknown')) x(v) LEFT JOIN (SELECT o_orderkey, {SEV_SQL} AS s FROM orders) ON s = v GROUP BY 1")
def a12(spark, d):
    """Severity distribution with zero-fill."""
    return agg.zero_filled(_findings(spark, d), "severity", [*agg.SEVERITY_WEIGHTS, "unknown"], "severity")


@query("a13", f"SELECT o_orderstatus, round_even(avg({WEIGHT_SQL}) * 10, 1) AS risk_score FROM orders GROUP BY 1")
def a13(spark, d):
    return _findings(spark, d).groupBy("o_orderstatus").agg(agg.risk_score(F.col("severity")).alias("risk_score"))


@query("a14", f"SELECT count(*) AS total, round_even(avg({WEIGHT_SQL}) * 10, 1) AS risk_score, count(*) FILTER (WHERE {SEV_SQL} = 'critical') AS critical, count(*) FILTER (WHERE o_orderstatus = 'F') AS fixed, count(DISTINCT o_orderpriority) AS kinds FROM orders")
def a14(spark, d):
    """Vulnerability report in one pass."""
    return _findings(spark, d).agg(_n("total"), agg.risk_score(F.col("severity")).alias("risk_score"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("o_orderstatus") == "F").alias("fixed"), F.count_distinct("o_orderpriority").alias("kinds"))


@query("a15", "SELECT category, passed, failed, passed + failed AS total, round(100.0 * passed / (passed + failed), 4)::DOUBLE AS score FROM (SELECT 'balance' AS category, count(*) FILTER (WHERE c_acctbal >= 0) AS passed, count(*) FILTER (WHERE NOT c_acctbal >= 0) AS failed FROM customer UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer)")
def a15(spark, d):
    """Compliance by category from a registry of checks."""
    reqs = [("R1", "balance", "at_least", {"column": "c_acctbal", "value": 0}), ("R2", "segment", "one_of", {"column": "c_mktsegment", "values": ["BUILDING", "MACHINERY"]})]
    out = agg.compliance(funnels.checked(table(spark, d, "customer"), reqs)).filter("category is not null")
    return out.withColumn("score", F.round("score", 4))


@query("a16", "SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS verified, count(*) FILTER (WHERE quality = 0) AS rejected, count(*) FILTER (WHERE toxic = 1) AS flagged FROM labels")
def a16(spark, d):
    return table(spark, d, "labels").agg(_n("total"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("verified"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("toxic") == 1).alias("flagged"))


@query("a17", "SELECT " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{x}') AS flag_{x.lower()}" for x in "ANR") + ", " + ", ".join(f"count(*) FILTER (WHERE l_linestatus = '{x}') AS status_{x.lower()}" for x in "FO") + " FROM lineitem")
def a17(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(*[F.count_if(F.col("l_returnflag") == x).alias(f"flag_{x.lower()}") for x in "ANR"], *[F.count_if(F.col("l_linestatus") == x).alias(f"status_{x.lower()}") for x in "FO"])


@query("a18", "SELECT event_type, round(avg(value), 4) AS rating, count(*) AS n FROM events GROUP BY 1")
def a18(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("rating"), _n())


@query("a19", "SELECT event_type AS query_hash, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def a19(spark, d):
    """Query statistics by hash."""
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("query_hash")).agg(_n(), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 4).alias("mean"))


@query("a20", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 4)::DOUBLE AS hit_rate FROM events GROUP BY 1")
def a20(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(agg.share(F.count_if(F.col("event_type") == "click"), F.count("*")), 4).alias("hit_rate"))


@query("a21", """WITH x AS (SELECT user_id, arg_min(value, (ts, value)) AS a, arg_max(value, (ts, value)) AS b FROM events GROUP BY 1), g AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE (b - a) * 100 / a END AS growth FROM x)
SELECT user_id, a AS first, b AS last, round(growth, 4) AS growth, CASE WHEN growth > 5 THEN 'growing' WHEN growth < -5 THEN 'shrinking' ELSE 'stable' END AS trend, growth > 20 AS leak FROM g""")
def a21(spark, d):
    """First against last sample."""
    return agg.trend(table(spark, d, "events"), ["user_id"], "ts", "value").withColumn("growth", F.round("growth", 4))


@query("a22", "WITH f AS (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines, o_custkey IN (SELECT c_custkey FROM customer) AS has_owner FROM orders) SELECT count(*) AS total, count(*) FILTER (WHERE has_lines) AS has_lines, count(*) FILTER (WHERE has_owner) AS has_owner, round(100.0 * count(*) FILTER (WHERE has_lines) / count(*), 2)::DOUBLE AS has_lines_percent, round(100.0 * count(*) FILTER (WHERE has_owner) / count(*), 2)::DOUBLE AS has_owner_percent FROM f")
def a22(spark, d):
    """Coverage percentages of relations."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("has_lines")).distinct()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("has_owner"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(li, "o_orderkey", "left").join(c, "o_custkey", "left")
    return agg.coverage(rows.select(*[F.coalesce(x, F.lit(False)).alias(x) for x in ("has_lines", "has_owner")]), ["has_lines", "has_owner"])


@query("a23", f"SELECT kind, count(*) AS n FROM (SELECT {case_sql(rules.SOURCE_TYPES, default="'unknown_source'")} AS kind FROM documents) GROUP BY 1")
def a23(spark, d):
    kind = rules.first_match(F.col("text"), rules.SOURCE_TYPES, "unknown_source")
    return table(spark, d, "documents").groupBy(kind.alias("kind")).agg(_n())


@query("a24", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def a24(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(_n())


@query("a25", "SELECT lang, n, round(100.0 * n / max(n) OVER (), 2)::DOUBLE AS bar FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def a25(spark, d):
    """Language statistics with bars in percent of the largest."""
    return agg.bars(table(spark, d, "documents"), "lang")


@query("a26", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def a26(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("a27", "SELECT count(*) AS found, count(*) FILTER (WHERE regexp_extract(url, '/(en|de)/', 1) <> '') AS mapped, count(*) FILTER (WHERE regexp_extract(url, '/(en|de)/', 1) = '') AS unmapped FROM pages")
def a27(spark, d):
    hit = F.regexp_extract("url", "/(en|de)/", 1) != ""
    return table(spark, d, "pages").agg(_n("found"), F.count_if(hit).alias("mapped"), F.count_if(~hit).alias("unmapped"))


@query("a28", "SELECT count(*) AS processed, count(*) FILTER (WHERE length(text) >= 200) AS created FROM documents")
def a28(spark, d):
    """Documents read and nodes created, counted by the write itself."""
    whole = F.length("text") >= 200
    counts = written(table(spark, d, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/graphweir/nodes-{uuid.uuid4().hex}", whole, processed=F.count("*"), created=F.count_if(whole))
    return spark.createDataFrame([(counts["processed"], counts["created"])], "processed long, created long")


@query("a29", "SELECT count(*) AS customers, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, round(sum(c_acctbal), 2) AS balance FROM customer")
def a29(spark, d):
    return table(spark, d, "customer").agg(_n("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("a30", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def a30(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(_n())
    return table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("a31", "SELECT l_orderkey, bool_and(l_linestatus = 'F') AS fixed FROM lineitem GROUP BY 1")
def a31(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("fixed"))


@query("a32", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 300")
def a32(spark, d):
    """The newest turns within a token budget."""
    c = table(spark, d, "conversations")
    return agg.within_budget(c, ["conv_id"], "turn", F.size(F.split("text", " ")), 300).select("conv_id", "turn")


@query("o1", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def o1(spark, d):
    return table(spark, d, "orders").orderBy(F.desc_nulls_first("o_orderdate"), "o_orderkey").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("o2", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def o2(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id")


def _first_vector(spark, d):
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query("o3", f"SELECT e.vec_id FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {COS} >= 0.1 ORDER BY {COS} DESC, e.vec_id LIMIT 10")
def o3(spark, d):
    return vector.search(table(spark, d, "embeddings"), "embedding", _first_vector(spark, d), 0.1, 10).select("vec_id")


@query("o4", f"SELECT o_orderkey, {SEV_SQL} AS severity, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def o4(spark, d):
    """Severity rank, then confidence; the first hundred."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(agg.SEVERITY_WEIGHTS) for x in (s, i)])
    f = _findings(spark, d).withColumn("rank", F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(999)))
    top = f.orderBy("rank", F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", "severity", F.row_number().over(Window.orderBy("rank", F.desc("o_totalprice"), "o_orderkey")).alias("place").cast("bigint"))


@query("o5", "SELECT event_id FROM events WHERE event_type = 'error'")
def o5(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").select("event_id")


@query("o6", "SELECT c_custkey, strftime(coalesce(max(o_orderdate), TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def o6(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("m"))
    rows = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return rows.select("c_custkey", F.date_format(F.coalesce("m", F.lit("1970-01-01").cast("timestamp")), "yyyy-MM-dd").alias("last")).orderBy(F.desc("last"), "c_custkey")


@query("o7", "SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts DESC, event_id DESC LIMIT 10")
def o7(spark, d):
    kept = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return kept.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id")


@query("o8", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC")
def o8(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(_n()).orderBy(F.desc("n"), "event_type")


@query("o9", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000) ON o_orderkey = l_orderkey GROUP BY 1")
def o9(spark, d):
    """A limit in the middle of a pipeline."""
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(top, "l_orderkey").groupBy("l_returnflag").agg(_n())


@query("o10", "SELECT url FROM pages")
def o10(spark, d):
    return table(spark, d, "pages").select("url").orderBy("url")


@query("o11", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 10")
def o11(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").limit(10)


@query("v1", f"SELECT e.vec_id, round({COS}, 4) AS similarity_score, e.label FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {COS} >= 0.2 ORDER BY {COS} DESC, e.vec_id LIMIT 5")
def v1(spark, d):
    """Cosine search with a cutoff."""
    found = vector.search(table(spark, d, "embeddings"), "embedding", _first_vector(spark, d), 0.2, 5)
    return found.select("vec_id", F.round("similarity_score", 4).alias("similarity_score"), "label")


@query("v2", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q)
SELECT vec_id, round(s, 4) AS similarity_score, label FROM s WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 5""")
def v2(spark, d):
    """Search of a stored index; with all lists probed it is exact."""
    path = f"{shared_dir(spark)}/graphweir/index-{uuid.uuid4().hex}"
    vector_index.build(table(spark, d, "embeddings"), "embedding", path)
    found = vector_index.probe(spark, path, _first_vector(spark, d), "embedding", None, 0.2, 5)
    return found.select("vec_id", F.round("similarity_score", 4).alias("similarity_score"), "label")


@query("v3", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::BIGINT AS n_links FROM pages WHERE len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) > 0")
def v3(spark, d):
    """Entities by regular expression: links of a page, by the extractor of source code."""
    from graphweir.sources.code import entities

    found = entities(table(spark, d, "pages").withColumn("language", F.lit("HTML")), "page_id", "html")
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"))


@query("v4", "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:3], chr(10))) AS digest FROM documents")
def v4(spark, d):
    """Lines two to three of every text."""
    return table(spark, d, "documents").select("doc_id", F.sha2(rules.code_slice(F.col("text"), F.lit(2), F.lit(3)), 256).alias("digest"))


@query("v5", "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_sections FROM documents")
def v5(spark, d):
    """Section parse: each line of a text becomes a section of its own, and they are counted."""
    from graphweir.sources.files import sections

    marked = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("SECTION: x\nCONTENT: "), x)), "\n").alias("text"))
    return sections(marked, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_sections"))


@query("w22", "SELECT doc_id, length(substr(text, 1, 10000)) AS n, length(text) AS full_length FROM documents")
def w22(spark, d):
    from graphweir.sources.files import chunk_node

    rows = table(spark, d, "documents").select("doc_id", chunk_node(F.col("text")).alias("c"))
    return rows.select("doc_id", F.length("c.content").cast("bigint").alias("n"), F.col("c.full_length").cast("bigint").alias("full_length"))


def _audit(spark, d):
    """The events as audit events, with a component per type and no checksum for clicks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # sealing and opening a line takes far longer than reading it: a file's rows go to more tasks than its bytes ask for
    e = table(spark, d, "events").repartition(n).select(
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("user_id").cast("string").alias("user_id"), F.lit("web").alias("component"), F.from_json("props", "map<string,string>").alias("details"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("source_ip"), F.when(F.col("event_type") == "error", False).alias("success"),
        F.lit(None).cast("string").alias("resource_id"), F.lit(None).cast("string").alias("session_id"),
    )
    return audit.with_checksum(e)


START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 12)


@query("q1", "SELECT event_id::VARCHAR AS event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00' AND event_type IN ('error', 'purchase') AND event_type = 'error'")
def q1(spark, d):
    """Audit query: sealed JSON lines, range, filters, checksum, newest first."""
    key = F.unhex(F.md5(F.lit("round trip")))
    log = audit.parsed(audit.lines(_audit(spark, d), key), key)
    return audit.query_events(log, START, END, ["error", "purchase"], level="ERROR", success=False).select("event_id")


@query("f34", "SELECT event_id::VARCHAR AS event_id FROM events WHERE event_id % 10 <> 3")
def f34(spark, d):
    """Events that were changed after their checksum was taken are rejected."""
    e = _audit(spark, d).withColumn("user_id", F.when(F.col("event_id").cast("bigint") % 10 == 3, "intruder").otherwise(F.col("user_id")))
    return e.filter(F.col("checksum") == F.sha2(audit.canonical(), 256)).select("event_id")


@query("w14", "SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d') AS date FROM events")
def w14(spark, d):
    """Audit append: one line per event in its day's partition, every checksum sound."""
    log = audit.parsed(audit.lines(_audit(spark, d)))
    return log.filter(F.col("checksum") == F.sha2(audit.canonical(), 256)).select("event_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("s15", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s15(spark, d):
    """Log lines, some sealed and some broken, read back."""
    key = F.unhex(F.md5(F.lit("round trip")))
    e = _audit(spark, d)
    plain, sealed = audit.lines(e.filter("level = 'INFO'")), audit.lines(e.filter("level = 'ERROR'"), key)
    broken = plain.limit(3).select("date", F.lit("{not json").alias("value"))
    return audit.parsed(plain.unionByName(sealed).unionByName(broken), key).groupBy("event_type").agg(_n())


@query("w18", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def w18(spark, d):
    """Violations saved as JSON and loaded with their schema."""
    raw = table(spark, d, "lineitem").select(F.to_json(F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("j"))
    return raw.select(F.from_json("j", "l_orderkey bigint, l_linenumber int, l_returnflag string").alias("v")).select("v.*")


@query("w19", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def w19(spark, d):
    """Retention: the log's folders of days before the cutoff are deleted; what is left is read."""
    path = f"{shared_dir(spark)}/graphweir/log-{uuid.uuid4().hex}"
    table(spark, d, "events").select("event_id", F.to_date("ts").alias("date")).repartition("date").write.partitionBy("date").parquet(path)
    retention.retain(spark, path, "date", "2024-01-20")
    return spark.read.parquet(path).select("event_id")


@query("t1", "SELECT event_id, ts FROM events")
def t1(spark, d):
    """ISO text and back."""
    iso = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"))
    return iso.select("event_id", F.try_to_timestamp("iso").alias("ts"))


@query("t2", "SELECT count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def t2(spark, d):
    """The last 24 hours, up to the newest event."""
    e = table(spark, d, "events")
    end = e.agg(F.max("ts").alias("end"))
    return e.join(end).filter("ts > end - interval 1 day").agg(_n())


@query("t3", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY 1")
def t3(spark, d):
    """Whole days of a range, the last one included."""
    return table(spark, d, "events").withColumn("day", F.to_date("ts")).filter(F.col("day").between("2024-01-05", "2024-01-09")).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(_n())


@query("t4", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def t4(spark, d):
    """Epoch milliseconds to ISO."""
    ms = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return ms.select("event_id", F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("t6", "SELECT count(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') < '2024-01-15'")
def t6(spark, d):
    return table(spark, d, "events").filter(F.to_date("ts") < F.lit("2024-01-15").cast("date")).agg(_n())


@query("t7", "SELECT count(*) AS expired FROM events WHERE ts + INTERVAL 300 SECOND < TIMESTAMP '2024-01-15'")
def t7(spark, d):
    """Locks and tokens past their expiry."""
    return table(spark, d, "events").filter(F.expr("ts + interval 300 seconds < timestamp'2024-01-15'")).agg(_n("expired"))


@query("j19", f"SELECT doc_id, CASE WHEN {any_sql(rules.SOURCE_ANSWERS)} THEN 0 ELSE 1 END AS analyzer FROM documents WHERE {any_sql(rules.SOURCE_ANSWERS)} OR {any_sql(rules.SOURCE_DOC_KEYWORDS)}")
def j19(spark, d):
    """Analyzer cascade: the first that confirms wins."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("description"))
    return funnels.cascade(docs, [funnels.AnswerAnalyzer(), funnels.DocumentationAnalyzer()], "source").select("doc_id", "analyzer")


@query("j21", "SELECT o_orderkey, coalesce(n, 0) AS n_actions, part FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey)::VARCHAR AS part FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j21(spark, d):
    """Findings with their actions, gathered before the join."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    rows = findings.attached(table(spark, d, "orders").select("o_orderkey"), li, "o_orderkey", "actions", "l_partkey", "l_linenumber")
    return rows.select("o_orderkey", F.coalesce(F.array_size("actions"), F.lit(0)).cast("bigint").alias("n_actions"), F.try_element_at("actions", F.lit(1))["l_partkey"].cast("string").alias("part"))


@query("j23", "SELECT conv_id, n, last FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1) USING (conv_id)")
def j23(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id").distinct().join(c.groupBy("conv_id").agg(_n(), F.max("turn").alias("last")), "conv_id", "left")


@query("j24", "SELECT l_orderkey, l_partkey, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 40")
def j24(spark, d):
    """Finding to CVE correlation."""
    p = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey", "left").select("l_orderkey", "l_partkey", "p_name")


@query("w23", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'fixed' ELSE 'identified' END AS status FROM orders WHERE o_orderpriority <> '5-LOW'")
def w23(spark, d):
    """Findings updated in part, some deleted."""
    f = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.lit("identified").alias("status"))
    changes = f.filter("o_totalprice > 400000").select("o_orderkey", F.lit("FIXED").alias("status"))
    kept, _ = findings.deleted(findings.updated(f, changes, "o_orderkey"), f.select("o_orderkey"), f.filter("o_orderpriority = '5-LOW'"), "o_orderkey")
    return kept.select("o_orderkey", "status")


@query("w24", "SELECT o_orderkey, CASE WHEN d THEN 'fixed' ELSE 'identified' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def w24(spark, d):
    """Findings roll up to fixed when all their actions are completed."""
    f = table(spark, d, "orders").select("o_orderkey", F.lit("identified").alias("status"))
    actions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("open").alias("status"))
    return findings.rolled_up(f, actions, "o_orderkey")


DOC_SOURCE = f"SELECT doc_id, source, {case_sql(rules.SOURCE_TYPES, default="'unknown_source'")} AS kind, round(least(0.3 + 0.1 * {count_sql(rules.SOURCE_DOC_KEYWORDS)}, 0.8), 4)::DOUBLE AS confidence FROM documents WHERE {any_sql(rules.SOURCE_KEYWORDS)} AND {any_sql(rules.SOURCE_DOC_KEYWORDS)}"


def _functions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("description"), F.col("source").alias("file_path"))


@query("j16", f"SELECT doc_id, coalesce(source, 'unknown') AS file_path FROM documents WHERE {any_sql(rules.SOURCE_KEYWORDS)}")
def j16(spark, d):
    """Funnel candidates: one row per function whose summary holds a keyword."""
    return funnels.KeywordFunnel().sources(_functions(spark, d)).select("doc_id", "file_path")


@query("w13", DOC_SOURCE)
def w13(spark, d):
    """Typed sources, ready to be written back as nodes."""
    typed = funnels.typed(funnels.KeywordFunnel().sources(_functions(spark, d)), funnels.DocumentationAnalyzer(), "source")
    return typed.select("doc_id", F.col("file_path").alias("source"), "kind", "confidence")


@query("w15", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def w15(spark, d):
    """A graph exported as JSON lines, a folder for each region, and its nodes counted as they are read back."""
    path = f"{shared_dir(spark)}/graphweir/export-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    funnels.export_nodes(n, "n_regionkey", path)
    back = spark.read.schema("value string, n_regionkey bigint").text(path).filter(F.from_json("value", "id string, label string")["id"].isNotNull())
    return back.groupBy("n_regionkey").agg(_n())


@query("w17", """SELECT 0 AS part, NULL AS at, unnest(['## Sources (' || count(*) || ')', '', '| Name | Type | Confidence | Description |', '|------|------|------------|-------------|']) AS line FROM supplier
UNION ALL SELECT 1, s_suppkey, '| ' || s_name || ' | user_input | 0.80 | ' || s_suppkey || ' |' FROM supplier UNION ALL SELECT 2, NULL, ''""")
def w17(spark, d):
    """A section of the Markdown report, line by line."""
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("user_input").alias("kind"), F.lit(0.8).alias("confidence"), F.col("s_suppkey").cast("string").alias("description"), "s_suppkey")
    return funnels.markdown_lines(s, "Sources", "s_suppkey", "No sources identified.").drop("k")


@query("w20_exists", "SELECT doc_id, 'number' AS property FROM documents WHERE regexp_extract(text, '[0-9]+') = '' OR text IS NULL UNION ALL SELECT doc_id, 'lang' FROM documents WHERE lang IS NULL")
def w20_exists(spark, d):
    """Existence constraints as a query for the nodes that lack a property."""
    from graphweir.operators.model import missing_properties

    docs = table(spark, d, "documents").select("doc_id", "lang", F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")).alias("number"))
    return missing_properties(docs, "doc_id", "number", "lang")


@query("w20", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def w20(spark, d):
    """A uniqueness constraint as a query for its violations."""
    from graphweir.operators.model import duplicate_keys

    return duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("c1", "SELECT c_custkey AS id, c_name AS title, coalesce(n_name, 'Unknown Repository') AS repository, coalesce(n, 0) AS findings FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def c1(spark, d):
    """Investigation list with a fallback for the repository, newest first."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(_n(), F.max("o_orderdate").alias("at"))
    rows = table(spark, d, "customer").join(n, "c_nationkey", "left").join(o, "c_custkey", "left").orderBy(F.desc_nulls_first("at"), "c_custkey")
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.coalesce("n_name", F.lit("Unknown Repository")).alias("repository"), F.coalesce("n", F.lit(0)).alias("findings"))


@query("c2", "SELECT c_custkey, c_name, count(DISTINCT l_partkey) AS vulnerabilities, CASE WHEN c_acctbal < 0 THEN 'open' ELSE 'closed' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, c_acctbal")
def c2(spark, d):
    """Investigation detail with a distinct count, taken before the join."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    v = o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("l_partkey").alias("v"))
    rows = table(spark, d, "customer").join(v, "c_custkey", "left")
    return rows.select("c_custkey", "c_name", F.coalesce("v", F.lit(0)).alias("vulnerabilities"), F.when(F.col("c_acctbal") < 0, "open").otherwise("closed").alias("status"))


@query("c3", f"SELECT o_custkey, o_orderkey, {SEV_SQL} AS severity FROM orders JOIN customer ON c_custkey = o_custkey")
def c3(spark, d):
    f = _findings(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return f.select("o_custkey", "o_orderkey", "severity")


SUBGRAPH = "SELECT 'customer:' || c_custkey AS source, 'order:' || o_orderkey AS target, 'PLACED' AS type FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' UNION SELECT 'order:' || o_orderkey, 'part:' || l_partkey, 'CONTAINS' FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'"


def _subgraph(spark, d):
    start = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    one = patterns.hop(start, "id", edges(spark, d, "PLACED"), "o")
    two = patterns.hop(one, "o", edges(spark, d, "CONTAINS"), "p")
    links = one.select(F.col("id").alias("source"), F.col("o").alias("target"), F.col("o_type").alias("type")).unionByName(two.select(F.col("o").alias("source"), F.col("p").alias("target"), F.col("p_type").alias("type")))
    return links.distinct()


@query("c4", SUBGRAPH)
def c4(spark, d):
    """Investigation graph: the links, each once."""
    return _subgraph(spark, d)


@query("c5", f"WITH l AS ({SUBGRAPH}) SELECT id, count(*) AS degree FROM (SELECT source AS id FROM l UNION ALL SELECT target FROM l) GROUP BY 1")
def c5(spark, d):
    """The same graph's nodes with their degrees."""
    links = _subgraph(spark, d)
    return links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).groupBy("id").agg(_n("degree"))


@query("c6", "SELECT o_orderkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def c6(spark, d):
    """Files with their entities: counts per file."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))
    return table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left").select("o_orderkey", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("c7", "SELECT lang, count(*) AS total, count(l.doc_id) AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def c7(spark, d):
    """Summary coverage by language."""
    lab = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    return table(spark, d, "documents").select("doc_id", "lang").join(lab, "doc_id", "left").groupBy("lang").agg(_n("total"), F.count("has").alias("labelled"))


@query("c8", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)")
def c8(spark, d):
    """Entities that lack a summary."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("c9", "SELECT DISTINCT id FROM (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer:' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1)")
def c9(spark, d):
    """Knowledge-graph neighbourhood, two deep."""
    root = nodes(spark, d, "Region").filter("id = 'region:1'").select("id")
    one = patterns.hop(root, "id", edges(spark, d, "IN_REGION"), "a", direction="in")
    two = patterns.hop(one, "a", edges(spark, d, "LIVES_IN"), "b", direction="in", optional=True)
    return two.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()


@query("c10", f"WITH s AS ({DOC_SOURCE}) SELECT kind, count(*) AS n, round(avg(confidence), 4) AS confidence FROM s GROUP BY 1")
def c10(spark, d):
    """Sources report: funnel, analyzer, counts by type."""
    typed = funnels.typed(funnels.KeywordFunnel().sources(_functions(spark, d)), funnels.DocumentationAnalyzer(), "source")
    return typed.groupBy("kind").agg(_n(), F.round(F.avg("confidence"), 4).alias("confidence"))


@query("c11", "SELECT n_name, coalesce(c, 0) AS paths, coalesce(k, 0) AS findings FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c, count(DISTINCT o_orderpriority) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey")
def c11(spark, d):
    """Repository listing with vulnerability counts: paths, and distinct kinds."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    x = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(o, "c_custkey").groupBy("n_nationkey").agg(_n("c"), F.count_distinct("o_orderpriority").alias("k"))
    return table(spark, d, "nation").join(x, "n_nationkey", "left").select("n_name", F.coalesce("c", F.lit(0)).alias("paths"), F.coalesce("k", F.lit(0)).alias("findings"))


@query("c12", "SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2")
def c12(spark, d):
    """Language scope."""
    return table(spark, d, "documents").filter("lang is not null").groupBy("source", "lang").agg(_n())


@query("c13", "SELECT n_regionkey, p_type, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def c13(spark, d):
    """Entity types below each root: counts are taken at the lowest join first."""
    t = table
    per_order = t(spark, d, "lineitem").join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").groupBy("l_orderkey", "p_type").agg(_n())
    per_cust = per_order.join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy("o_custkey", "p_type").agg(F.sum("n").alias("n"))
    places = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    return per_cust.join(places, "o_custkey").groupBy("n_regionkey", "p_type").agg(F.sum("n").alias("n"))


@query("c14", "SELECT p_partkey, p_name, count(DISTINCT l_orderkey) AS used_in, count(DISTINCT l_suppkey) AS related FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2")
def c14(spark, d):
    """Entities with their related calls."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("a"), F.count_distinct("l_suppkey").alias("b"))
    return table(spark, d, "part").join(x, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("a", F.lit(0)).alias("used_in"), F.coalesce("b", F.lit(0)).alias("related"))


@query("c15", "SELECT count(*) FILTER (WHERE l_orderkey IS NULL) AS orphans, count(*) FILTER (WHERE l_orderkey IS NOT NULL) AS owned FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
def c15(spark, d):
    """Orphans and owned entities."""
    li = table(spark, d, "lineitem").select("l_orderkey").distinct()
    x = table(spark, d, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return x.agg(F.count_if(F.col("l_orderkey").isNull()).alias("orphans"), F.count("l_orderkey").alias("owned"))


@query("c16", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND turn >= 2")
def c16(spark, d):
    """Context listing: optional filters, newest first."""
    c = findings.filtered(table(spark, d, "conversations"), {"role": "user", "conv_id": None}, {"turn": 2})
    return c.orderBy(F.desc("turn"), "conv_id").select("conv_id", "turn", "role")


@query("v6", "SELECT o_orderkey, 'order ' || o_orderkey AS source, 'customer ' || o_custkey AS sink, 'medium' AS impact FROM orders")
def v6(spark, d):
    """Data-flow paths out of written answers."""
    from graphweir.operators.answers import flow_paths

    text = F.concat(F.lit("Source: order "), F.col("o_orderkey").cast("string"), F.lit("\nSink: customer "), F.col("o_custkey").cast("string"), F.lit("\nDescription: it flows\nand more\nRecommendation: check\n- twice"))
    return flow_paths(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t").select("o_orderkey", "source", "sink", "impact")


@query("f35", "SELECT item_id, length(text) AS n FROM benchmark")
def f35(spark, d):
    """The batch boundary of an embedding service, with a stand-in that measures."""
    from graphweir.sources.external import answered

    out = answered(table(spark, d, "benchmark"), "text", lambda: lambda texts: [[float(len(t))] for t in texts], "array<double>", "embedding")
    return out.select("item_id", F.col("embedding")[0].cast("bigint").alias("n"))


@query("v7", "SELECT item_id, substr(text, 1, 12) AS summary FROM benchmark WHERE length(trim(text)) >= 10")
def v7(spark, d):
    """The batch boundary of a summary service, with a stand-in that shortens."""
    from graphweir.sources.external import summaries

    return summaries(table(spark, d, "benchmark"), lambda: lambda texts: [t[:12] for t in texts], "text").select("item_id", "summary")


@query("t5", "SELECT count(*) AS n FROM region")
def t5(spark, d):
    """Server time: one value for all rows of a query."""
    stamped = table(spark, d, "region").withColumn("at", F.current_timestamp())
    return stamped.groupBy("at").agg(_n()).select("n")
