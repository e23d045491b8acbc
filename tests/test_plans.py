"""Plans that prune, split and count: point lookups, paths from both ends, budgets, retention, observed writes, fan-out."""

import random

import pytest
from pyspark.sql import functions as F

from graphweir.operators import aggregates, expand, model
from graphweir.plans import retention
from graphweir.plans.observed import Progress, written
from graphweir.streaming import events as ev
from tests.test_catalog import DATA, needs_data


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@needs_data
def test_a_lookup_reads_one_table_with_a_pushed_filter(spark):
    found = model.node_by_id(spark, DATA, "customer:42")
    plan = plan_of(found)
    assert plan.count("Scan parquet") == 2 and "EqualTo(c_custkey,42)" in plan  # once in the tree, once in its details
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in model.nodes(spark, DATA).filter("id = 'customer:42'").collect()]
    for odd in ("customer:", "customer:x", "customer:042", "nobody:1", "", "customer:²", "region:-1"):
        assert model.node_by_id(spark, DATA, odd).collect() == model.nodes(spark, DATA).filter(F.col("id") == odd).collect() == []


@pytest.mark.parametrize("n", range(5))
def test_pairs_between_equal_brute_force(spark, n):
    rng = random.Random(n)
    chain = [[(rng.randrange(12), rng.randrange(12)) for _ in range(25)] for _ in range(n)]
    starts, ends = [1, 2, 3, 3], [0, 4, 5]
    found = {(s, s) for s in starts}
    for e in chain:
        found = {(s, b) for s, x in found for a, b in e if a == x}
    frames = [spark.createDataFrame([*e, *e[:3], (None, 1), (1, None)], "src long, dst long") for e in chain]
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    got = expand.pairs_between(ids(starts), frames).collect()
    assert {tuple(r) for r in got} - {(s, None) for s in starts} == found and len(got) == len({tuple(r) for r in got})
    assert sorted(tuple(r) for r in expand.pairs_between(ids(starts), frames, ids(ends)).collect()) == sorted(p for p in found if p[1] in ends)


def test_a_budget_over_one_key_of_a_million_rows(spark):
    n, budget = 1_000_000, 700_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), "id", (F.col("id") % 3).alias("t"))
    out = aggregates.within_budget(rows, ["k"], "id", F.col("t"), budget)
    ids = out.agg(F.min("id"), F.max("id"), F.count("*")).first()
    used, first = 0, n
    while first and used + (first - 1) % 3 <= budget:
        first -= 1
        used += first % 3
    assert tuple(ids) == (first, n - 1, n - first)
    sizes = sorted(r[0] for r in aggregates.within_budget(rows, ["k"], "id", F.col("t"), n * 3).groupBy(F.spark_partition_id()).agg(F.count("*")).collect())
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_budgets_of_many_keys_with_nulls(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "c"]), i, rng.choice([None, 0, 1, 5, 40])) for i in range(400)]
    want = set()
    for k in {r[0] for r in rows}:
        used = 0
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            used += t or 0
            if used > 300:
                break
            want.add(i)
    df = spark.createDataFrame(rows, "k string, i long, t int").withColumn("__gw_part", F.lit(1))
    out = aggregates.within_budget(df, ["k"], "i", F.col("t"), 300)
    assert {r.i for r in out.collect()} == want and out.columns == df.columns
    assert aggregates.within_budget(df.limit(0), ["k"], "i", F.col("t"), 300).count() == 0


def test_retention_deletes_old_days_alone(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [(i, day) for i, day in enumerate(["2024-01-01", "2024-01-19", "2024-01-20", None, "2025-03-01", "2023-12-31"])]
    spark.createDataFrame(rows, "id int, date string").write.partitionBy("date").parquet(path)
    (tmp_path / "log" / "notes").mkdir()
    (tmp_path / "log" / "date=soon").mkdir()
    named = retention.retain(spark, path, "date", "2024-01-20", dry_run=True)
    assert [n.rsplit("=")[-1] for n in named] == ["2023-12-31", "2024-01-01", "2024-01-19"] and spark.read.parquet(path).count() == 6
    assert retention.retain(spark, path, "date", "2024-01-20") == named and retention.retain(spark, path, "date", "2024-01-20") == []
    left = {p.name for p in (tmp_path / "log").iterdir() if p.is_dir()}
    assert left == {"date=2024-01-20", "date=2025-03-01", "date=__HIVE_DEFAULT_PARTITION__", "notes", "date=soon"}


def test_counts_of_a_write(spark, tmp_path):
    rows = spark.range(1000).withColumn("odd", F.col("id") % 2 == 1)
    counts = written(rows, f"file://{tmp_path}/w", F.col("odd"), processed=F.count("*"), created=F.count_if("odd"), last=F.max("id"))
    assert counts == {"processed": 1000, "created": 500, "last": 999} and spark.read.parquet(f"file://{tmp_path}/w").count() == 500


def test_progress_of_a_stream(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(path)
    follow = Progress("seen", "processed", 30, 60.0, 30.0)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)
    out = ev.observed(stream, "seen", follow, processed=F.count("*"), big=F.count_if(F.col("id") >= 20))
    assert out.count() == 30 and follow.counts == {"processed": 30, "big": 10}
    assert follow.percents[0] == 70.0 and follow.percents[-1] == follow.percent() == 90.0 and sorted(follow.percents) == follow.percents


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = [(i, t) for i, t in enumerate(["purchase", "view", "error", "purchase", "other"])]
    df = spark.createDataFrame(rows, "event_id long, event_type string")
    df.coalesce(1).write.parquet(path)
    routed = ev.routed(spark.readStream.schema(df.schema).parquet(path)).select("event_id", "channel")
    out = ev.fan_out(routed, "channels")
    of = lambda c: sorted(r.event_id for r in ev.received(spark, out, c, "event_id long").collect())
    want = {"telemetry": [0, 3], "user_interaction": [0, 1, 3], "purchase": [0, 3], "system": [2], "other": [4], "nobody": []}
    assert {c: of(c) for c in want} == want
    ev.put_batch(ev.routed(df).select("event_id", "channel"), 0, out)
    assert {c: of(c) for c in want} == want
    ev.put_batch(ev.routed(df.limit(1)).select("event_id", "channel"), 1, out)
    assert of("telemetry") == [0, 0, 3]
    assert "channel" in plan_of(ev.received(spark, out, "system", "event_id long")).split("PartitionFilters")[1].split("\n")[0]
    assert ev.received(spark, f"file://{tmp_path}/none", "system", "event_id long").count() == 0


def test_a_report_keeps_its_order_over_files(spark, tmp_path):
    from graphweir.operators import funnels

    rows = spark.range(5000).select(F.concat(F.lit("f"), "id").alias("name"), F.lit("user_input").alias("kind"), F.lit(0.5).alias("confidence"), F.lit("d").alias("description"), "id")
    funnels.write_report(funnels.markdown_lines(rows.repartition(7), "Sources", "id", "None."), f"file://{tmp_path}/r")
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    head = "## Sources (5000)\n\n| Name | Type | Confidence | Description |\n|------|------|------------|-------------|\n"
    assert text == head + "".join(f"| f{i} | user_input | 0.50 | d |\n" for i in range(5000)) + "\n"
    none = [r.line for r in funnels.markdown_lines(rows.limit(0), "Sources", "id", "None.").orderBy("part", "at", "k").collect()]
    assert none == ["## Sources (0)", "", "None.", ""]
