"""The life of findings and remediation actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status words.
STATUSES = ("identified", "verified", "false_positive", "accepted", "in_progress", "fixed", "closed")


def filtered(rows: DataFrame, equal: dict[str, object | None], least: dict[str, float | None] | None = None) -> DataFrame:
    """Conjunctive filters; a filter that is None is skipped."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None] + [F.col(c) >= v for c, v in (least or {}).items() if v is not None]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: non-null values of ``changes`` win; unknown statuses are rejected; new keys are not added."""
    new = changes.select(F.col(key).alias("__k"), *[F.col(c).alias("__" + c) for c in changes.columns if c != key])
    joined = rows.join(new, F.col(key) == F.col("__k"), "left")

    def value(c: str) -> Column:
        if c == key or c not in changes.columns:
            return F.col(c)
        v = F.col("__" + c)
        if c == "status":
            v = F.when(F.lower(v).isin(*STATUSES), F.lower(v))
        return F.coalesce(v, F.col(c)).alias(c)

    return joined.select(*[value(c) for c in rows.columns])


def deleted(rows: DataFrame, actions: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Findings and actions without the findings in ``gone``."""
    ids = gone.select(key).distinct()
    return rows.join(ids, key, "left_anti"), actions.join(ids, key, "left_anti")


def rolled_up(rows: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Findings all of whose actions are completed become fixed; those without actions stay."""
    done = actions.groupBy(key).agg(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("__done"))
    return rows.join(done, key, "left").withColumn("status", F.when(F.col("__done"), "fixed").otherwise(F.col("status"))).drop("__done")


def attached(rows: DataFrame, actions: DataFrame, key: str, name: str, *fields: str) -> DataFrame:
    """``rows`` with their actions as a sorted array of structs, gathered before the join."""
    packed = actions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return rows.join(packed, key, "left")
