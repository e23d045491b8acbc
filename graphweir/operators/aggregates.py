"""Report aggregations: zero-filled counts, risk and compliance scores, coverage, trends, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweir.plans.durable import durable, free_names

# Weights of the five severities.
SEVERITY_WEIGHTS = {"critical": 10, "high": 7, "medium": 4, "low": 1, "info": 0}


def zero_filled(rows: DataFrame, column: str, values: list[str], label: str = "value") -> DataFrame:
    """A count for every value of a small dimension, 0 where there are no rows."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(v,) for v in values], f"{label} string")
    counts = rows.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("n"))
    return dim.join(counts, F.col(label) == F.col("__v"), "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def weight_of(severity: Column, weights: dict[str, int] = SEVERITY_WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(severity)), F.lit(0))


def risk_score(severity: Column) -> Column:
    """Mean severity weight on a scale of 0 to 100, to one decimal, half to even; 0 for no rows."""
    return F.bround(F.coalesce(F.avg(weight_of(severity)), F.lit(0.0)) * 10, 1)


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole``, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part * F.lit(scale), whole), F.lit(0.0))


def compliance(results: DataFrame) -> DataFrame:
    """Passed, failed, total and score in percent per category, and for all (category null)."""
    passed = F.count_if("compliant")
    aggs = [passed.alias("passed"), F.count_if(~F.col("compliant")).alias("failed"), F.count("*").alias("total"), share(passed, F.count("*"), 100.0).alias("score")]
    return results.rollup("category").agg(*aggs)


def critique(categories: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean rating of a review's categories, and the issues of all of them in the categories' order."""
    issues = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("issues", F.array().cast("array<string>")).alias("i"))))
    return categories.groupBy(*keys).agg(F.avg("rating").alias("rating"), F.flatten(F.transform(issues, lambda x: x["i"])).alias("issues"))


def trend(samples: DataFrame, keys: list[str], at: str, value: str, leak: float = 20.0) -> DataFrame:
    """First and last sample, growth in percent, and its class, per key."""
    ends = samples.groupBy(*keys).agg(F.min_by(value, F.struct(at, value)).alias("first"), F.max_by(value, F.struct(at, value)).alias("last"))
    growth = share(F.col("last") - F.col("first"), F.col("first"), 100.0)
    kind = F.when(growth > 5, "growing").when(growth < -5, "shrinking").otherwise("stable")
    return ends.withColumn("growth", growth).withColumn("trend", kind).withColumn("leak", growth > leak)


def within_budget(rows: DataFrame, keys: list[str], order: str, tokens: Column, budget: int) -> DataFrame:
    """The newest rows of each key whose tokens fit the budget together; older ones are evicted.  Null tokens count as none.

    A prefix sum in two levels: rows are dealt into ranges of (key, newest first), so a key of any size spans many tasks; each range sums its
    own, and the sums of a key's ranges, a row for each, are added up to what lies before each range.
    """
    used, local, part, before, size = free_names(rows, "used", "local", "part", "before", "size")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.withColumn(used, F.coalesce(tokens, F.lit(0)).cast("bigint")).repartitionByRange(n, *keys, F.desc(order)).withColumn(part, F.spark_partition_id())
    ranges = durable(ranges, "ranges").repartitionById(n, part)  # a range is one task again: its rows need no further exchange
    newest = Window.partitionBy(part, *keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.withColumn(local, F.sum(used).over(newest))
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(part, *keys).agg(F.sum(used).alias(size)).withColumn(before, F.sum(size).over(ahead)).filter(F.col(before).isNotNull())
    held = totals.select(F.col(part).alias(f"{part}_"), *[F.col(k).alias(f"{part}_{i}") for i, k in enumerate(keys)], before)
    same = reduce(lambda a, b: a & b, [F.col(part) == F.col(f"{part}_"), *[F.col(k).eqNullSafe(F.col(f"{part}_{i}")) for i, k in enumerate(keys)]])
    return summed.join(held, same, "left").filter(F.col(local) + F.coalesce(before, F.lit(0)) <= budget).select(*rows.columns)


def coverage(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rows, and for each boolean flag how many have it and their percentage."""
    counts = [F.count("*").alias("total")] + [F.count_if(f).alias(f) for f in flags]
    return rows.agg(*counts).select("total", *flags, *[F.round(share(F.col(f), F.col("total"), 100.0), 2).alias(f"{f}_percent") for f in flags])


def bars(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value with their percentage of the largest."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("most"))
    return counts.join(top).select(column, "n", F.round(share(F.col("n"), F.col("most"), 100.0), 2).alias("bar"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
