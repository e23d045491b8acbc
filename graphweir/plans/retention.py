"""Partitions of a stored table past their time, listed and deleted by the file system that holds them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from graphweir.plans.durable import drop_table


def expired(spark: SparkSession, path: str, column: str, cutoff: str) -> list[str]:
    """Folders ``column=<ISO date>`` below ``path`` whose date is before ``cutoff``, oldest first; other folders are never named."""
    limit = dt.date.fromisoformat(cutoff)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in system.listStatus(place):
        name, _, value = status.getPath().getName().partition("=")
        if status.isDirectory() and name == column:
            try:
                day = dt.date.fromisoformat(value)
            except ValueError:  # the partition of nulls, or another kind of value
                continue
            if day < limit:
                found.append((day, status.getPath().toString()))
    return [folder for _, folder in sorted(found)]


def retain(spark: SparkSession, path: str, column: str, cutoff: str, dry_run: bool = False) -> list[str]:
    """Deletes the partitions before ``cutoff`` and returns them; a dry run only names them.  Running it again deletes nothing more."""
    gone = expired(spark, path, column, cutoff)
    if not dry_run:
        for folder in gone:
            drop_table(spark, folder)
    return gone
