"""Further queries of operators whose first query does not show all that they do."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphweir.functions import text as rules
from graphweir.operators import aggregates, funnels, mutations, vector_index
from graphweir.operators.model import node_id
from graphweir.plans.durable import shared_dir
from graphweir.plans.session import table
from graphweir.plans.timing import QueryLog
from graphweir.queries.scans import any_sql, case_sql
from graphweir.registry import query
from graphweir.sources import feeds, fetch, files
from graphweir.sources.code import defines, entities
from graphweir.streaming import events as ev


@query("s11", "SELECT 'plain;x=' || p_partkey AS name, 'data:text/plain;x=' || p_partkey || ',' || replace(p_name, ' ', '%20') AS source, p_name AS content, length(p_name)::INT AS content_length FROM part")
def s11(spark, d):
    """Remote documents as document nodes, a request for each url of a table; data urls of the parts' names need no network."""
    url = F.concat(F.lit("data:text/plain;x="), F.col("p_partkey").cast("string"), F.lit(","), F.replace("p_name", F.lit(" "), F.lit("%20")))
    found = files.document_nodes(files.fetched_documents(table(spark, d, "part").select(url.alias("url"))))
    return found.select(F.regexp_extract("name", "^(.*?),", 1).alias("name"), "source", "content", "content_length")


def _cve(key):
    """A part's CVE id; a long key keeps all of its digits."""
    return F.format_string("CVE-2024-%06d", key)


def _service(spark, d) -> str:
    """A service that knows the small parts, by pages of records; returns its url."""
    base = f"{shared_dir(spark)}/graphweir/service-{uuid.uuid4().hex}"
    p = table(spark, d, "part").filter("p_size <= 5")
    record = F.to_json(F.struct(_cve("p_partkey").alias("id"), F.array(F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value"))).alias("descriptions")))
    p.select(fetch.page(_cve("p_partkey")).alias("page"), record.alias("value")).repartition("page").write.partitionBy("page").text(base)
    return (base if "://" in base else "file://" + base) + "/page={page}/"


@query("s16_keyed", """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 404 ELSE 200 END AS status, p_name AS description
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 5""")
def s16_keyed(spark, d):
    """Records that a table's rows name, each page of them requested once; a second run over the landed records asks for nothing."""
    url, landing = _service(spark, d), f"{shared_dir(spark)}/graphweir/landing-{uuid.uuid4().hex}"
    ids = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _cve("l_partkey").alias("id"))
    fetch.fetched(ids, "id", url, landing, "^CVE-2024-[0-9]+$")
    again = fetch.fetched(ids, "id", url.replace("/page=", "/gone="), landing, "^CVE-2024-[0-9]+$")  # the service is gone
    return again.select("l_orderkey", "l_linenumber", "status", F.get_json_object("body", "$.descriptions[0].value").alias("description"))


@query("s16_point", "SELECT 'CVE-2024-' || lpad(p_partkey::VARCHAR, 6, '0') AS cve_id, p_name AS description FROM part WHERE p_size <= 5 AND p_partkey <= 100")
def s16_point(spark, d):
    """Records by an IN list that the source takes as its requests; keys without a record are left out."""
    keys = [f"CVE-2024-{k:06d}" for k in range(101)]
    found = fetch.records(spark, _service(spark, d)).filter(F.col("id").isin(keys) & (F.col("status") == 200))
    return feeds.cves(found.select("body"), "body").select("cve_id", "description")


@query("s16_fetch", """SELECT l_orderkey, cve_id, p_name AS description, CASE WHEN p_size IS NULL THEN NULL WHEN p_size > 25 THEN 'high' ELSE 'low' END AS severity
FROM (SELECT DISTINCT l_orderkey, l_partkey, 'CVE-2024-' || l_partkey AS cve_id FROM lineitem WHERE l_partkey >= 1000) LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 0""")
def s16_fetch(spark, d):
    """Records of the well-formed CVE ids that findings name, from a feed that lacks half of them."""
    p = table(spark, d, "part").filter("p_size % 2 = 0")
    score = F.array(F.struct(F.struct(F.lit(1.0).alias("baseScore"), F.when(F.col("p_size") > 25, "HIGH").otherwise("LOW").alias("baseSeverity")).alias("cvssData")))
    record = F.struct(
        F.concat(F.lit("CVE-2024-"), F.col("p_partkey").cast("string")).alias("id"),
        F.array(F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value"))).alias("descriptions"),
        F.struct(score.alias("cvssMetricV31")).alias("metrics"),
    )
    ids = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("CVE-2024-"), F.col("l_partkey").cast("string")).alias("cve_id")).distinct()
    return feeds.fetched_cves(ids, p.select(F.to_json(record).alias("json")), "cve_id").select("l_orderkey", "cve_id", "description", "severity")


@query("s19_zip", "SELECT 'CWE-' || p_partkey AS cwe_id, p_brand AS name, p_name AS description FROM part")
def s19_zip(spark, d):
    """Weakness records out of zip archives, one for each brand."""

    def zipped(frame):
        import io
        import zipfile

        import pandas as pd

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "<Weakness none")
            z.writestr("cwe.xml", "<Catalog>" + "\n".join(frame["xml"]) + "</Catalog>")
        return pd.DataFrame({"content": [held.getvalue()]})

    xml = F.format_string('<Weakness ID="%s" Name="%s"><Description>%s</Description></Weakness>', "p_partkey", "p_brand", "p_name")
    archives = table(spark, d, "part").select("p_brand", xml.alias("xml")).groupBy("p_brand").applyInPandas(zipped, "content binary")
    return feeds.weaknesses_zip(archives.unionByName(archives.limit(1).select(F.lit(b"broken").alias("content"))))


F26 = "SELECT conv_id, turn, {types} AS kind FROM conversations"


@query("f26_types", f"SELECT conv_id, turn, {case_sql(rules.SOURCE_ANSWER_TYPES, default="'unknown_source'")} AS source_type, {case_sql(rules.SINK_ANSWER_TYPES, default="'unknown_sink'")} AS sink_type FROM (SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' user-supplied' WHEN 1 THEN ' a file to load' WHEN 2 THEN ' an API, fetched' WHEN 3 THEN ' create a file' ELSE ' the shell' END AS text FROM conversations)")
def f26_types(spark, d):
    """Types out of written answers: ordered rules of their own, other than those for documentation."""
    said = F.when(F.col("turn") % 5 == 0, " user-supplied").when(F.col("turn") % 5 == 1, " a file to load").when(F.col("turn") % 5 == 2, " an API, fetched").when(F.col("turn") % 5 == 3, " create a file").otherwise(" the shell")
    c = table(spark, d, "conversations").withColumn("text", F.concat("text", said))
    analyzer = funnels.AnswerAnalyzer()
    return c.select("conv_id", "turn", analyzer.source(F.col("text"))[1].alias("source_type"), analyzer.sink(F.col("text"))[1].alias("sink_type"))


@query("f27_ids", """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 4 || '.' || o_orderkey % 7 END AS version, CASE WHEN o_orderkey % 2 = 0 THEN ['CWE-' || o_custkey, 'CWE-79'] ELSE ['CWE-79'] END AS cwe_ids,
CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 11 WHEN 2 THEN 7 END::INT AS place FROM orders""")
def f27_ids(spark, d):
    """CWE ids, versions and places named in text."""
    version = F.when(F.col("o_custkey") % 3 == 0, F.lit("Perl 5.1 and python")).otherwise(F.concat(F.lit("Python  "), (F.col("o_custkey") % 4).cast("string"), F.lit("."), (F.col("o_orderkey") % 7).cast("string"), F.lit(".9")))
    cwe = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" CWE"), F.col("o_custkey").cast("string"))).otherwise(F.lit(" CWE-"))
    place = F.when(F.col("o_orderkey") % 4 == 0, " is # 3 of 10").when(F.col("o_orderkey") % 4 == 1, " the 11th").when(F.col("o_orderkey") % 4 == 2, " Number 7").otherwise(" numbers 8")
    text = F.concat(version, cwe, F.lit(" cwe-79"), place)
    return table(spark, d, "orders").select("o_orderkey", rules.named_version(text, "python").alias("version"), rules.cwe_ids(text).alias("cwe_ids"), rules.ordinal(text).alias("place"))


@query("j16_linked", f"""SELECT doc_id AS node_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 10 = 4 THEN 'f' || doc_id % 50 ELSE 'unknown' END AS file_path, doc_id % 7 AS line_number FROM documents WHERE {any_sql(rules.SINK_KEYWORDS)}""")
def j16_linked(spark, d):
    """Funnel candidates: functions of the repository's files first, then those that no file of it defines."""
    docs = table(spark, d, "documents")
    functions = docs.select(F.col("doc_id").alias("node_id"), F.col("lang").alias("name"), (F.col("doc_id") % 7).alias("line_number"))
    summaries = docs.select(F.col("doc_id").alias("node_id"), F.col("text").alias("summary"))
    defined = docs.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("node_id"), (F.col("doc_id") % 50).alias("file_node_id"))
    all_files = spark.range(50).select(F.col("id").alias("file_node_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    part_of = all_files.select("file_node_id", (F.col("file_node_id") % 10).alias("repository"))
    found = funnels.linked_candidates(functions, summaries, defined, part_of, all_files, F.col("repository") == 4, rules.SINK_KEYWORDS)
    return found.select("node_id", "file_path", "line_number")


@query("j18_found", """SELECT source, count(*) FILTER (WHERE a) AS n_sources, count(*) FILTER (WHERE b) AS n_sinks, (count(*) FILTER (WHERE a)) * (count(*) FILTER (WHERE b)) - count(*) FILTER (WHERE a AND b) AS n_pairs
FROM (SELECT source, contains(lower(text), 'the') AS a, contains(lower(text), 'on') AS b FROM documents) GROUP BY 1 HAVING n_sources > 0 AND n_sinks > 0""")
def j18_found(spark, d):
    """Sources and sinks that share a file, on words that occur."""
    t = F.lower("text")
    docs = table(spark, d, "documents").select("source", F.contains(t, F.lit("the")).alias("a"), F.contains(t, F.lit("on")).alias("b"))
    per = docs.groupBy("source").agg(F.count_if("a").alias("n_sources"), F.count_if("b").alias("n_sinks"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    return per.filter("n_sources > 0 and n_sinks > 0").select("source", "n_sources", "n_sinks", (F.col("n_sources") * F.col("n_sinks") - F.col("both")).alias("n_pairs"))


@query("w4_merge", """WITH e AS (SELECT DISTINCT 'part:' || l_partkey AS src, 'order:' || l_orderkey AS dst, l_linenumber > 3 AS old FROM lineitem)
SELECT src, dst, 'PART_OF' AS type FROM (SELECT DISTINCT src, dst FROM e)""")
def w4_merge(spark, d):
    """Merge into edges of which a part is there already: each edge is there once afterwards."""
    li = table(spark, d, "lineitem")
    e = li.select(node_id("Part", "l_partkey").alias("src"), node_id("Order", "l_orderkey").alias("dst"), F.lit("PART_OF").alias("type"), "l_linenumber")
    return mutations.merge_edges(e.filter("l_linenumber > 3").drop("l_linenumber").distinct(), e.drop("l_linenumber"))


@query("a18_issues", """SELECT user_id, round(avg(value), 4) AS rating, string_agg(i, '|' ORDER BY event_id, k) AS issues
FROM (SELECT user_id, event_id, value, k, event_type || k AS i FROM events, (SELECT unnest([1, 2]) AS k)) GROUP BY 1""")
def a18_issues(spark, d):
    """Reviews: mean rating of the categories, and their issues one after the other."""
    issues = F.array(F.concat("event_type", F.lit("1")), F.concat("event_type", F.lit("2")))
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("rating"), issues.alias("issues"))
    out = aggregates.critique(rows, ["user_id"], "event_id")
    return out.select("user_id", F.round("rating", 4).alias("rating"), F.array_join("issues", "|").alias("issues"))


@query("v2_exact", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q)
SELECT vec_id, round(s, 4) AS similarity_score FROM s ORDER BY s DESC, vec_id LIMIT 5""")
def v2_exact(spark, d):
    """A table of queries against a stored index, every list probed: the scores and the order are the exact ones."""
    rows = table(spark, d, "embeddings")
    path = f"{shared_dir(spark)}/graphweir/index-{uuid.uuid4().hex}"
    vector_index.build(rows, "embedding", path, lists=16)
    found = vector_index.probe_each(path, rows.filter("vec_id = 0").withColumnRenamed("vec_id", "query"), "query", "embedding", "embedding", None, -1.0, 5)
    return found.select("vec_id", F.round("similarity_score", 4).alias("similarity_score"))


@query("v3_code", """SELECT p_partkey, 'Python' AS language, unnest(['Function', 'Function', 'Class']) AS kind, unnest(['f' || p_partkey, 'g', 'C' || p_size]) AS name, unnest([1, 6, 5]) AS start_line FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'Java', unnest(['Function', 'Class']), unnest(['m' || p_size, 'J' || p_partkey]), unnest([3, 2]) FROM part WHERE p_partkey % 2 = 1""")
def v3_code(spark, d):
    """Functions and classes of source files, with their lines."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    python = F.concat(F.lit("def f"), key, F.lit("(a):\n  x = 'undefined'\n  return x\n\nclass C"), size, F.lit(":\n  def  g (self): pass\n"))
    java = F.concat(F.lit("// a\nclass J"), key, F.lit(" {\n  public int m"), size, F.lit("(int a) {\n    return a;\n  }\n}"))
    p = table(spark, d, "part")
    sources = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "Python").otherwise("Java").alias("language"), F.when(F.col("p_partkey") % 2 == 0, python).otherwise(java).alias("content"))
    return entities(sources, "p_partkey", "content").select("p_partkey", "language", "kind", "name", "start_line")


@query("v3_defines", "SELECT p_partkey AS source, p_partkey || ':Function:1:f' || p_size AS target, 'DEFINES' AS type FROM part")
def v3_defines(spark, d):
    """Edges from files to the entities that they define."""
    code = table(spark, d, "part").select("p_partkey", F.lit("Python").alias("language"), F.concat(F.lit("def f"), F.col("p_size").cast("string"), F.lit("():\n  pass")).alias("content"))
    return defines(entities(code, "p_partkey", "content"), "p_partkey")


@query("e7_filtered", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def e7_filtered(spark, d):
    """Client filters without the wildcard: two subscriptions, each with its own channel only."""
    e = table(spark, d, "events").withColumn("channel", F.col("event_type"))
    return ev.subscribed(e, "error").unionByName(ev.subscribed(e, "purchase")).select("event_id", "event_type")


@query("x2_flow", f"""WITH t AS (SELECT doc_id, 'file' || doc_id % 45 AS file_path, {case_sql(rules.SOURCE_TYPES, default="'unknown_source'")} AS a, {case_sql(rules.SINK_TYPES, default="'unknown_sink'")} AS b FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'reads user input' WHEN 1 THEN 'executes a command' WHEN 2 THEN 'update the database' ELSE 'import environment' END AS text FROM documents))
SELECT s.doc_id AS source, k.doc_id AS sink, CASE WHEN k.b = 'command_execution' THEN 'command injection' ELSE 'sql injection' END AS vulnerability_type, CASE WHEN k.b = 'command_execution' THEN 'high' ELSE 'medium' END AS impact
FROM t s JOIN t k USING (file_path) WHERE s.a = 'user_input' AND s.doc_id % 4 IN (0, 3) AND k.doc_id % 4 IN (1, 2) AND k.b IN ('command_execution', 'database_write')""")
def x2_flow(spark, d):
    """An analyzer's data flows between typed sources and sinks of the same file."""
    said = F.element_at(F.array(*map(F.lit, ("reads user input", "executes a command", "update the database", "import environment"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.concat(F.lit("file"), (F.col("doc_id") % 45).cast("string")).alias("file_path"), said.alias("description"))
    analyzer = funnels.DocumentationAnalyzer()
    return funnels.flows(funnels.typed(docs, analyzer, "source"), funnels.typed(docs, analyzer, "sink"), analyzer).drop("file_path")


@query("x6", "SELECT 'orders' AS query, 2 AS n, count(*) AS rows, true AS timed FROM orders UNION ALL SELECT 'lineitem', 1, count(*), true FROM lineitem")
def x6(spark, d):
    """Query timing: how often each named query ran, what it counted, and whether its time was taken."""
    log = QueryLog()
    counted = {}
    for name in ("orders", "orders", "lineitem"):
        with log.timed(name):
            counted[name] = table(spark, d, name).count()
    rows = spark.createDataFrame(list(counted.items()), "query string, rows long")
    return log.frame(spark).groupBy("query").agg(F.count("*").cast("int").alias("n"), (F.min("seconds") > 0).alias("timed")).join(rows, "query").select("query", "n", "rows", "timed")
