"""Sources and scans, projections, filters and scalar expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphweir.functions import text as rules
from graphweir.operators import text_index
from graphweir.operators.model import node_by_id, nodes, nodes_sql
from graphweir.plans.durable import shared_dir
from graphweir.plans.session import table
from graphweir.registry import query
from graphweir.sources import feeds, files


@query("s1", "SELECT 'region:' || r_regionkey AS id, r_name AS name FROM region")
def s1(spark, d):
    """Label scan."""
    return nodes(spark, d, "Region").select("id", "name")


@query("s2", f"SELECT count(*) AS n_nodes FROM ({nodes_sql()})")
def s2(spark, d):
    """All-nodes scan."""
    return nodes(spark, d).agg(F.count("*").alias("n_nodes"))


@query("s3", nodes_sql("Customer", "Supplier", "Part"))
def s3(spark, d):
    """Multi-label scan."""
    return nodes(spark, d, "Customer", "Supplier", "Part")


@query("s4", f"SELECT id, label, name FROM ({nodes_sql()}) WHERE id = 'customer:42'")
def s4(spark, d):
    """Lookup by node id: one table, with a pushed filter."""
    return node_by_id(spark, d, "customer:42")


@query("s5", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 ORDER BY c_custkey LIMIT 100")
def s5(spark, d):
    """find_nodes: conjunctive equality, the first 100 by key."""
    c = table(spark, d, "customer")
    for k, v in {"c_mktsegment": "BUILDING", "c_nationkey": 3}.items():
        c = c.filter(F.col(k) == v)
    return c.orderBy("c_custkey").limit(100).select("c_custkey", "c_name")


@query("s6", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def s6(spark, d):
    """Lookup by business key, as a parameter."""
    return spark.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM {o} WHERE o_orderkey = :k", args={"k": 77}, o=table(spark, d, "orders"))


URL_PATH = "regexp_replace(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '/$', '')"


def _paths(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_replace(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), "/$", "").alias("path"))


@query("s7", f"SELECT page_id, {URL_PATH} AS path FROM pages WHERE NOT list_has_any(string_split({URL_PATH}, '/'), ['de', 'build']) AND NOT regexp_matches(lower({URL_PATH}), '\\.(png|zip)$')")
def s7(spark, d):
    """File walk with ignore sets, over the paths of the pages."""
    return _paths(spark, d).filter(rules.wanted_path(F.col("path"), ("de", "build"), ("png", "zip"))).select("page_id", "path")


@query("s8", "SELECT DISTINCT array_to_string(x[1:i], '/') AS path FROM (SELECT string_split(regexp_extract(url, '://([^/]+)', 1) || '/' || " + URL_PATH + ", '/') AS x FROM pages), range(1, 12) r(i) WHERE i < len(x)")
def s8(spark, d):
    """Directory listing: distinct parent prefixes."""
    return files.directories(_paths(spark, d).select(F.concat_ws("/", "host", "path").alias("path")))


@query("s9", "SELECT doc_id, length(text) AS n_chars FROM documents")
def s9(spark, d):
    """Text from bytes; malformed bytes would be replaced."""
    t = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return t.select("doc_id", F.length(F.make_valid_utf8(F.col("content").cast("string"))).cast("bigint").alias("n_chars"))


@query("s10", "SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '://[^?#]*')), '\\.(md|markdown|rst|txt|html|htm|xml|json|yaml|yml)$')")
def s10(spark, d):
    """Documents by extension."""
    return _paths(spark, d).filter(rules.extension(F.col("path")).isin(*files.DOCUMENT_EXTENSIONS)).select("page_id")


@query("s12", "SELECT regexp_extract(url, '://([^/]+)', 1) AS repo, count(*) AS n_files, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def s12(spark, d):
    """Repository statistics, a repository per host."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("repo"), F.length("html").alias("n"))
    return p.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum("n").alias("chars"))


@query("s13", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def s13(spark, d):
    """JSON documents with a schema, exploded as a map."""
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("s14", "SELECT o_orderkey, o_orderpriority FROM orders")
def s14(spark, d):
    """One JSON record per finding, read back with its schema."""
    raw = table(spark, d, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderpriority")).alias("json"))
    return raw.select(F.from_json("json", "o_orderkey bigint, o_orderpriority string").alias("r")).select("r.*")


@query("s16", "SELECT l_orderkey, 'CVE-' || (1990 + l_linenumber) || '-' || l_partkey AS cve FROM lineitem WHERE l_partkey >= 1000")
def s16(spark, d):
    """Only well-formed CVE ids pass."""
    cve = F.concat_ws("-", F.lit("CVE"), (1990 + F.col("l_linenumber")).cast("string"), F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", cve.alias("cve")).filter(rules.valid_cve(F.col("cve")))


@query("s17", "SELECT 'CVE-2024-' || (10000 + p_partkey) AS cve_id, p_name AS description, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS severity, p_size / 5.0::DOUBLE AS cvss_score, 1 AS n_cwe, p_brand AS cpe FROM part")
def s17(spark, d):
    """Nested CVE records flattened: version 3 metrics or else version 2, CWE ids only, CPE criteria."""
    p = table(spark, d, "part")
    big, score = F.col("p_size") > 25, F.col("p_size") / F.lit(5.0)
    v31 = F.when(big, F.array(F.struct(F.struct(score.alias("baseScore"), F.lit("HIGH").alias("baseSeverity")).alias("cvssData"))))
    v2 = F.array(F.struct(F.struct(score.alias("baseScore")).alias("cvssData"), F.lit("LOW").alias("baseSeverity")))
    record = F.struct(
        F.concat(F.lit("CVE-2024-"), (10000 + F.col("p_partkey")).cast("string")).alias("id"),
        F.array(F.struct(F.lit("fr").alias("lang"), F.lit("x").alias("value")), F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value"))).alias("descriptions"),
        F.struct(v31.alias("cvssMetricV31"), v2.alias("cvssMetricV2")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.lit("CWE-89").alias("value")), F.struct(F.lit("NVD-OTHER").alias("value"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(F.array(F.struct(F.col("p_brand").alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    )
    out = feeds.cves(p.select(F.to_json(record).alias("json")))
    return out.select("cve_id", "description", "severity", "cvss_score", F.size("cwe_ids").alias("n_cwe"), F.col("vulnerable_configurations")[0].alias("cpe"))


@query("s18", """SELECT 'bandit' AS tool, p_brand AS rule, p_size AS line, CASE WHEN p_type = 'ECONOMY' THEN 'low' WHEN p_type = 'STANDARD' THEN 'high' ELSE 'medium' END AS severity FROM part
UNION ALL SELECT 'semgrep', p_brand, p_size, CASE WHEN p_type = 'ECONOMY' THEN 'medium' WHEN p_type = 'STANDARD' THEN 'high' ELSE 'medium' END FROM part UNION ALL SELECT 'trufflehog', 'Secret Detection', p_size, 'high' FROM part""")
def s18(spark, d):
    """Output of three scanners in one schema; a broken line is skipped."""
    p = table(spark, d, "part")

    def word(low, high):
        return F.when(F.col("p_type") == "ECONOMY", low).when(F.col("p_type") == "STANDARD", high).otherwise("?")

    bandit = F.struct(F.array(F.struct(F.col("p_brand").alias("test_id"), F.lit("t").alias("issue_text"), F.col("p_name").alias("filename"), F.col("p_size").alias("line_number"), word("LOW", "HIGH").alias("issue_severity"))).alias("results"))
    semgrep = F.struct(F.array(F.struct(F.col("p_brand").alias("check_id"), F.col("p_name").alias("path"), F.struct(F.col("p_size").alias("line")).alias("start"), F.struct(word("WARNING", "ERROR").alias("severity")).alias("extra"))).alias("results"))
    hog = F.struct(F.col("p_brand").alias("DetectorType"), F.col("p_name").alias("SourceName"), F.struct(F.struct(F.col("p_size").alias("LineNumber")).alias("Data")).alias("SourceMetadata"))
    lines = p.select(F.explode(F.array(F.to_json(hog), F.lit("{broken"))).alias("json"))
    out = feeds.findings(p.select(F.to_json(bandit).alias("json")), "bandit").unionByName(feeds.findings(p.select(F.to_json(semgrep).alias("json")), "semgrep")).unionByName(feeds.findings(lines, "trufflehog"))
    return out.select("tool", "rule", "line", "severity")


@query("s19", "SELECT 'CWE-' || p_partkey AS cwe_id, p_brand AS name, p_name AS description FROM part")
def s19(spark, d):
    """Weakness records from XML."""
    xml = F.format_string('<Weakness ID="%s" Name="%s"><Description>%s</Description></Weakness>', "p_partkey", "p_brand", "p_name")
    return feeds.weaknesses_xml(table(spark, d, "part").select(xml.alias("xml")))


@query("s20", "SELECT 'Customer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def s20(spark, d):
    """Graph payload documents: nodes exploded and counted by type."""
    n = nodes(spark, d, "Customer", "Supplier")
    doc = n.select(F.to_json(F.struct(F.array(F.struct("id", F.col("name").alias("label"), F.col("label").alias("type"))).alias("nodes"))).alias("json"))
    return feeds.graph_payload(doc)[0].groupBy("type").agg(F.count("*").alias("n"))


@query("s21", "SELECT key, value FROM (SELECT event_type || user_id AS key, value::VARCHAR AS value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def s21(spark, d):
    """Configuration merge: per key the value of the highest priority."""
    e = table(spark, d, "events")
    merged = feeds.merged_config(e.select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("priority")))
    return merged.select("key", "value")


@query("f1", "SELECT s_suppkey AS id, s_name AS title FROM supplier")
def f1(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))


@query("f2", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def f2(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")


@query("f3", "SELECT count(*) FILTER (WHERE lang IS NULL) AS missing, count(*) FILTER (WHERE lang IS NOT NULL) AS present FROM documents")
def f3(spark, d):
    return table(spark, d, "documents").agg(F.count_if(F.col("lang").isNull()).alias("missing"), F.count_if(F.col("lang").isNotNull()).alias("present"))


@query("f4", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def f4(spark, d):
    """Membership in a list that may be large: a semi join."""
    ids = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(ids, "user_id", "left_semi").select("event_id")


@query("f5", f"SELECT id FROM ({nodes_sql('Region', 'Nation', 'Supplier')}) WHERE label <> 'Nation' AND (label = 'Region' OR label = 'Supplier')")
def f5(spark, d):
    return nodes(spark, d, "Region", "Nation", "Supplier").filter("label <> 'Nation' and (label = 'Region' or label = 'Supplier')").select("id")


@query("f6", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_brand, 'ring') ORDER BY p_partkey LIMIT 20")
def f6(spark, d):
    """Case-sensitive search over two properties through a stored index, the first 20 by key."""
    p, path = table(spark, d, "part"), f"{shared_dir(spark)}/graphweir/grams-{uuid.uuid4().hex}"
    text_index.build(p, "p_partkey", ["p_name", "p_brand"], path)
    return text_index.search(p, "p_partkey", ["p_name", "p_brand"], path, ["ring"]).orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


def any_sql(keywords, column="text"):
    return "(" + " OR ".join(f"contains(lower({column}), '{k.lower()}')" for k in keywords) + ")"


def count_sql(keywords, column="text"):
    return "(" + " + ".join(f"(length({column}) - length(replace(lower({column}), '{k}', ''))) // {len(k)}" for k in keywords) + ")"


def case_sql(rules_, column="text", default="NULL", fold=True):
    low = f"lower({column})" if fold else column

    def test(all_of, any_of):
        tests = [f"contains({low}, '{x}')" for x in all_of]
        if any_of:
            tests.append("(" + " OR ".join(f"contains({low}, '{x}')" for x in any_of) + ")")
        return " AND ".join(tests)

    return "CASE " + " ".join(f"WHEN {test(a, b)} THEN '{v}'" for v, a, b in rules_) + f" ELSE {default} END"


@query("f7", f"SELECT doc_id FROM documents WHERE {any_sql(('Password', 'license', 'TOKEN'))}")
def f7(spark, d):
    """Any of several keywords, in any case."""
    return table(spark, d, "documents").filter(rules.any_keyword(F.col("text"), ("Password", "license", "TOKEN"))).select("doc_id")


@query("f8", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders")
def f8(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(price > 250000, "big").when(price > 100000, "mid").otherwise("small").alias("size"))


@query("f9", "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN NULL ELSE 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'fine') AS verdict FROM labels")
def f9(spark, d):
    return table(spark, d, "labels").select("doc_id", F.coalesce(F.when(F.coalesce(F.col("quality"), F.lit(0)) != 1, "low"), F.when(F.col("toxic") == 1, "toxic"), F.lit("fine")).alias("verdict"))


def findings_filter(rows, priority=None, status=None, least=None):
    """Optional filters, each skipped when it is None."""
    for column, value in (("o_orderpriority", priority), ("o_orderstatus", status)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows if least is None else rows.filter(F.col("o_totalprice") >= least)


@query("f10", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice >= 200000")
def f10(spark, d):
    return findings_filter(table(spark, d, "orders"), priority="2-HIGH", least=200000).select("o_orderkey")


@query("f11", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def f11(spark, d):
    return table(spark, d, "part").filter("p_brand = 'Brand#2'").filter("p_type = 'ECONOMY'").select("p_partkey")


@query("f12", "SELECT event_id, ts FROM events WHERE event_type = 'error' AND user_id = 8 ORDER BY ts DESC")
def f12(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").filter("user_id = 8").orderBy(F.desc("ts")).select("event_id", "ts")


@query("f13", f"SELECT page_id FROM pages WHERE NOT list_has_any(string_split({URL_PATH}, '/'), ['en', 'fr'])")
def f13(spark, d):
    return _paths(spark, d).filter(~F.arrays_overlap(F.split("path", "/"), F.array(F.lit("en"), F.lit("fr")))).select("page_id")


@query("f14", f"SELECT page_id FROM pages WHERE NOT regexp_matches(lower({URL_PATH}), '\\.html$')")
def f14(spark, d):
    return _paths(spark, d).filter(~rules.extension(F.col("path")).isin("html")).select("page_id")


@query("f15", "SELECT page_id FROM pages WHERE length(html) <= 1500")
def f15(spark, d):
    return table(spark, d, "pages").filter(F.length("html") <= 1500).select("page_id")


@query("f16", "SELECT doc_id, length(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... [truncated]' ELSE text END) AS n FROM documents")
def f16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(rules.truncated(F.col("text"), 200)).cast("bigint").alias("n"))


@query("f17", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 100")
def f17(spark, d):
    return table(spark, d, "documents").filter(F.length(F.trim("text")) >= 100).select("doc_id")


@query("f18", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'info' END AS severity FROM orders")
def f18(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rules.mapped(F.col("o_orderpriority"), {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}, "info").alias("severity"))


@query("f19", "SELECT event_id, greatest(0.0, least(1.0, CASE WHEN value / 20 > 1 THEN value / 200 ELSE value / 20 END))::DOUBLE AS confidence FROM events")
def f19(spark, d):
    return table(spark, d, "events").select("event_id", rules.clamped(F.col("value") / 20).alias("confidence"))


@query("f20", f"SELECT page_id, CASE WHEN regexp_matches({URL_PATH}, '\\.html$') THEN 'html' ELSE 'unknown' END AS language FROM pages")
def f20(spark, d):
    return _paths(spark, d).select("page_id", rules.language_of(F.col("path")).alias("language"))


@query("f21", f"SELECT doc_id, {case_sql(rules.CONTENT_RULES, default="'Unknown'", fold=False)} AS kind FROM documents")
def f21(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.first_match(F.col("text"), rules.CONTENT_RULES, "Unknown", fold=False).alias("kind"))


@query("f22", f"SELECT page_id, regexp_matches({URL_PATH}, '\\.html$') AS code FROM pages")
def f22(spark, d):
    return _paths(spark, d).select("page_id", rules.is_code(F.col("path")).alias("code"))


@query("f23", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding FROM benchmark")
def f23(spark, d):
    content = F.when(F.col("item_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, d, "benchmark").select("item_id", rules.encoding_by_bom(content).alias("encoding"))


@query("f24", f"SELECT doc_id, {case_sql(rules.SOURCE_TYPES, default="'unknown_source'")} AS source_type, {case_sql(rules.SINK_TYPES, default="'unknown_sink'")} AS sink_type FROM documents")
def f24(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", rules.first_match(t, rules.SOURCE_TYPES, "unknown_source").alias("source_type"), rules.first_match(t, rules.SINK_TYPES, "unknown_sink").alias("sink_type"))


@query("f25", f"SELECT doc_id, round(least(0.3 + 0.1 * {count_sql(rules.SOURCE_DOC_KEYWORDS)}, 0.8), 4)::DOUBLE AS confidence FROM documents")
def f25(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(rules.keyword_confidence(F.col("text"), rules.SOURCE_DOC_KEYWORDS), 4).alias("confidence"))


@query("f26", f"SELECT conv_id, turn, {case_sql(rules.CERTAINTY, default="'0.5'")}::DOUBLE AS confidence FROM conversations")
def f26(spark, d):
    """How sure an answer sounds: ordered indicators, 0.5 by default."""
    score = rules.first_match(F.col("text"), rules.CERTAINTY, "0.5").cast("double")
    return table(spark, d, "conversations").select("conv_id", "turn", score.alias("confidence"))


@query("f27", "SELECT doc_id, regexp_extract(text, '(password|token) ?= ?\"?([0-9a-f]{8,})', 2) AS found FROM documents WHERE regexp_matches(text, '(password|token) ?= ?\"?[0-9a-f]{8,}')")
def f27(spark, d):
    pattern = '(password|token) ?= ?"?([0-9a-f]{8,})'
    return table(spark, d, "documents").filter(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 2).alias("found"))


@query("f28", "SELECT event_id, (user_id % 7, event_id % 5) > (3, 2) AS newer FROM events")
def f28(spark, d):
    a = F.concat_ws(".", F.lit("1"), (F.col("user_id") % 7).cast("string"), (F.col("event_id") % 5).cast("string"), F.lit("0"))
    return table(spark, d, "events").select("event_id", rules.newer(a, F.lit("1.3.2")).alias("newer"))


@query("f29", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def f29(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("f30", "SELECT c_custkey, c_custkey % 2 = 0 AS valid FROM customer")
def f30(spark, d):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "inv-").otherwise("x-"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", rules.valid_investigation(name).alias("valid"))


@query("f31", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), 'build')")
def f31(spark, d):
    return table(spark, d, "customer").filter(F.contains(F.lower("c_name"), F.lit("77")) | F.contains(F.lower("c_mktsegment"), F.lit("build"))).select("c_custkey")


@query("f32", "SELECT o_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND c_mktsegment <> 'HOUSEHOLD'")
def f32(spark, d):
    """Visible node types, then the links whose two ends remain."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    keep_o = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    keep_c = table(spark, d, "customer").filter("c_mktsegment <> 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(keep_o, "o_orderkey", "left_semi").join(keep_c, "o_custkey", "left_semi").select("o_custkey", "o_orderkey")


@query("f33", "SELECT c_custkey, c_name FROM customer")
def f33(spark, d):
    """Field-level encryption and back; the key here is made for the round trip only."""
    key = F.unhex(F.md5(F.lit("round trip")))
    sealed = table(spark, d, "customer").select("c_custkey", F.aes_encrypt(F.col("c_name").cast("binary"), key).alias("c"))
    return sealed.select("c_custkey", F.aes_decrypt("c", key).cast("string").alias("c_name"))


@query("f36", "SELECT event_id FROM events WHERE user_id = 8")
def f36(spark, d):
    return table(spark, d, "events").filter("user_id = 8").select("event_id")


@query("f37", "SELECT turn, role FROM conversations WHERE conv_id = 5 ORDER BY turn")
def f37(spark, d):
    return table(spark, d, "conversations").filter("conv_id = 5").orderBy("turn").select("turn", "role")


@query("f38", "SELECT page_id FROM pages WHERE NOT contains(url, 'example.net')")
def f38(spark, d):
    return table(spark, d, "pages").filter(~F.contains("url", F.lit("example.net"))).select("page_id")
