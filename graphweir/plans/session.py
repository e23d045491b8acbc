"""Session construction and table loading."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "graphweir", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster the caller brings its own session; nothing below relies on this function.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:  # the Python workers import this package too
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": os.environ.get("GRAPHWEIR_SHUFFLE", "8"),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("GRAPHWEIR_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
