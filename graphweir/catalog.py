"""All registered queries and the SQL they must equal."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from graphweir.registry import ORACLES, QUERIES

for _module in ("graph", "scans", "reports", "events", "more"):
    importlib.import_module(f"graphweir.queries.{_module}")

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The investigation list."""
    return QUERIES["c1"](spark, sf_dir)
