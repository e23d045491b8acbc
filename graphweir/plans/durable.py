"""Intermediate tables that outlive the executors that made them.

``spark.checkpoint.dir`` names the folder that all executors and the driver share.
It is read from the session.  Where it is unset, local sessions (tests) use a temporary folder
of this process, and sessions on a cluster are refused: each executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
ROW = "__gw_row"
#: Rows of a table that a join may send whole through the driver.
SENT_ROWS = 250_000
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one in local mode, where none is set."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"on a cluster, set {KEY} to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="graphweir-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> str:
    """Write ``df`` as Parquet into the shared folder; returns the path."""
    path = f"{shared_dir(df.sparkSession)}/graphweir/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return path


def durable(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` with its lineage cut at a table in the shared folder."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_table(df, name, codec))


def sized(table: DataFrame) -> DataFrame:
    """A durable table to join with, which is sent whole only if it has few rows.

    Spark decides by the size of the files, where sorted numbers take some three bytes a row;
    in the driver, which builds what is sent, the same row takes some hundred.
    """
    return table.hint("merge") if table.count() > SENT_ROWS else table


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Generations:
    """The tables of a loop: each new one replaces the one before, which is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        old, schema = self.path, df.schema
        self.path = write_table(df, self.name)
        if old:
            drop_table(self.spark, old)
        return self.spark.read.schema(schema).parquet(self.path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever its spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        free = next(n for k in itertools.count() if (n := f"__gw_{name}{k or ''}") not in taken)
        taken.add(free)
        out.append(free)
    return out


def tagged(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a durable table with a unique row number, and the name of its column, which no other column has.

    The number is fixed by the write, so every later plan sees the same one even if
    executors are lost; it tells apart rows that repeat a document id.
    """
    (row,) = free_names(df, "row")
    return durable(df.withColumn(row, F.monotonically_increasing_id()), "tagged"), row


def row_numbers(row_col: str | None) -> Column:
    """The column that tells rows apart, or new numbers where the caller has none."""
    return (F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")).alias(ROW)
