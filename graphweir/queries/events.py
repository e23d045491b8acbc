"""Streaming queries, run to the end over the events table, and the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweir.operators import audit, funnels
from graphweir.plans.observed import Progress
from graphweir.plans.session import table
from graphweir.registry import query
from graphweir.sources import feeds
from graphweir.streaming import events as ev

CHANNELS = "SELECT event_id, event_type AS channel FROM events " + " ".join(f"UNION ALL SELECT event_id, '{c}' FROM events WHERE event_type = '{k}'" for k, cs in ev.KINDS.items() for c in cs)


def _stream(spark, d):
    return ev.stream(spark, f"{d}/events.parquet")


@query("e1", f"SELECT channel, count(*) AS n FROM ({CHANNELS}) GROUP BY 1")
def e1(spark, d):
    """Publish and subscribe by type: subclasses reach the channels of their parents."""
    out = ev.run(ev.routed(_stream(spark, d)).select("event_id", "channel"), "routed")
    return out.groupBy("channel").agg(F.count("*").alias("n"))


@query("e2", f"SELECT event_id FROM ({CHANNELS}) WHERE channel = 'user_interaction'")
def e2(spark, d):
    """Fan-out: what one channel's subscriber receives; the source is read once for all channels."""
    path = ev.fan_out(ev.routed(_stream(spark, d)).select("event_id", "channel"), "channels")
    return ev.received(spark, path, "user_interaction", "event_id long")


@query("e4", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def e4(spark, d):
    """Recent-events view, kept up batch by batch."""
    return ev.recent(ev.latest(_stream(spark, d), "recent")).select("event_id")


@query("e6", f"""WITH RECURSIVE a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6 AS t, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0 AS failures, 0.0::DOUBLE AS until, 0.0::DOUBLE AS t, false AS locked FROM a
UNION ALL SELECT user_id, i, CASE WHEN held THEN failures WHEN failed THEN base + 1 ELSE 0 END, CASE WHEN held THEN until WHEN failed AND base + 1 >= {ev.MOST_FAILURES} THEN t + {ev.LOCK_SECONDS} ELSE 0 END, t, NOT held AND failed AND base + 1 >= {ev.MOST_FAILURES}
    FROM (SELECT a.user_id, a.i, a.t, a.failed, s.failures, s.until, s.until > a.t AS held, CASE WHEN s.until > 0 THEN 0 ELSE s.failures END AS base FROM s JOIN a ON a.user_id = s.user_id AND a.i = s.i + 1))
SELECT user_id, t AS locked_at, until AS locked_until FROM s WHERE locked""")
def e6(spark, d):
    """Lockouts: five failures lock an account for 300 seconds."""
    e = table(spark, d, "events").filter("event_type in ('error', 'signup')")
    return ev.lockouts(e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), (F.col("event_type") == "error").alias("failed")).withColumn("at", F.col("us") / 1e6))


@query("e7", "SELECT event_id FROM events")
def e7(spark, d):
    """Client filter with a wildcard."""
    return ev.subscribed(table(spark, d, "events").withColumn("channel", F.col("event_type")), "*").select("event_id")


@query("e8", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def e8(spark, d):
    """System events appended to the audit log, lines parsed back."""
    e = _stream(spark, d).select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").cast("timestamp").alias("timestamp"))
    log = ev.run(e.select(F.to_date("timestamp").alias("date"), F.to_json(F.struct("event_id", "event_type", "timestamp"), audit.OPTIONS).alias("value")), "audit")
    return audit.parsed(log).groupBy("event_type").agg(F.count("*").alias("n"))


@query("e9", "SELECT user_id, round(20 + 30 * (count(*) FILTER (WHERE event_type = 'purchase')) / count(*), 4)::DOUBLE AS percent FROM events GROUP BY 1")
def e9(spark, d):
    """Progress of a stage that spans 20 to 50 percent."""
    p = ev.progress(F.count_if(F.col("event_type") == "purchase"), F.count("*"), 20.0, 30.0)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(p, 4).alias("percent"))


@query("e9_stream", "SELECT count(*) AS processed, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, 50.0::DOUBLE AS percent FROM events")
def e9_stream(spark, d):
    """Progress of a stage from 20 to 50 percent, followed while its stream runs; the counts are those of the written rows."""
    follow = Progress("ingest", "processed", table(spark, d, "events").count())
    ev.observed(_stream(spark, d).select("event_id", "event_type"), "observed", follow, processed=F.count("*"), purchases=F.count_if(F.col("event_type") == "purchase"))
    return spark.createDataFrame([(follow.counts["processed"], follow.counts["purchases"], follow.percent())], "processed long, purchases long, percent double")


@query("ext_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_windows(spark, d):
    """Extension: event-time windows with a watermark, as a stream."""
    out = ev.run(ev.windowed_counts(_stream(spark, d)), "windows", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("x1", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'password')")
def x1(spark, d):
    """A funnel of the user's own."""
    own = funnels.KeywordFunnel(sources=("license", "password"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("description"), F.col("source").alias("file_path"))
    return own.sources(docs).select("doc_id")


@query("x2", "SELECT doc_id, 'long' AS kind FROM documents WHERE length(text) > 5000")
def x2(spark, d):
    """An analyzer of the user's own: Columns in, Columns out."""

    class Long:
        def source(self, description):
            return F.length(description) > 5000, F.lit("long"), F.lit(1.0)

        sink = source

    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("description"))
    return funnels.typed(docs, Long(), "source").select("doc_id", "kind")


@query("x3", "SELECT requirement_id, count(*) FILTER (WHERE ok) AS passed FROM (SELECT 'R1' AS requirement_id, lang IS NOT NULL AS ok FROM documents UNION ALL SELECT 'R2', regexp_matches(source, '^src[0-9]$') FROM documents) GROUP BY 1")
def x3(spark, d):
    """Registered compliance checks."""
    reqs = [("R1", "lang", "present", {"column": "lang"}), ("R2", "source", "matches", {"column": "source", "pattern": "^src[0-9]$"})]
    out = funnels.checked(table(spark, d, "documents"), reqs)
    return out.groupBy("requirement_id").agg(F.count_if("compliant").alias("passed"))


@query("x4", "SELECT 'semgrep' AS tool, p_brand AS rule, count(*) AS n FROM part GROUP BY 2")
def x4(spark, d):
    """A registered tool's parser."""
    doc = F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("check_id"))).alias("results")))
    return feeds.findings(table(spark, d, "part").select(doc.alias("json")), "semgrep").groupBy("tool", "rule").agg(F.count("*").alias("n"))
