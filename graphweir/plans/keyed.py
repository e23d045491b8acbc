"""Tables with a key, changed in place partition by partition.

Rows lie in partitions by a hash of their key.  A change reads and rewrites only the partitions that hold changed keys (copy on write, dynamic partition
overwrite); the files of all others stay as they are.  A change that fails half way can be run again: merging the same rows twice gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.operators.mutations import upsert
from graphweir.plans.durable import drop_table

BUCKET = "gw_bucket"


class KeyedTable:
    """A Parquet table at ``path`` with the key columns ``key``, in ``buckets`` partitions: as many as keep one of a size that is cheap to rewrite."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, dynamic: bool) -> None:
        # the rebalance keeps a partition's rows together and splits those that are larger than others
        writer = rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET)
        writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Write the table anew.  Rows with a null in their key are kept; no change will match them."""
        self._write(rows.withColumn(BUCKET, self._bucket()), False)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def find(self, *value) -> DataFrame:
        """The rows with one key; one partition is read."""
        rows = self.spark.read.parquet(self.path)
        kinds = {f.name: f.dataType for f in rows.schema}
        literals = [F.lit(v).cast(kinds[k]) for k, v in zip(self.key, value, strict=True)]
        number = self.spark.range(1).select(F.pmod(F.xxhash64(*literals), F.lit(self.buckets)).cast("int")).first()[0]
        rows = rows.filter(F.col(BUCKET) == number)
        for k, v in zip(self.key, literals, strict=True):
            rows = rows.filter(F.col(k) == v)
        return rows.drop(BUCKET)

    def _touched(self, changes: DataFrame) -> list[int]:
        """The partitions of the changed keys, ``buckets`` at most."""
        return sorted(r[0] for r in changes.select(self._bucket().alias(BUCKET)).distinct().collect())

    def _keyed(self, changes: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in self.spark.read.parquet(self.path).schema}
        for k in self.key:
            changes = changes.filter(F.col(k).isNotNull()).withColumn(k, F.col(k).cast(kinds[k]))
        return changes

    def merge(self, changes: DataFrame) -> list[int]:
        """Set what ``changes`` sets (non-null values) in rows with its keys, and add the others; returns the partitions rewritten.

        Of changes to the same key the largest row counts; changes with a null in their key are left out.  Columns that the table lacks are refused.
        """
        rows = self.spark.read.parquet(self.path)
        if unknown := set(changes.columns) - set(rows.columns):
            raise ValueError(f"columns that the table lacks: {sorted(unknown)}")
        changes = self._keyed(changes)
        rest = [c for c in changes.columns if c not in self.key]
        if rest:
            changes = changes.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("gw_row")).select(*self.key, "gw_row.*")
        else:
            changes = changes.distinct()
        touched = self._touched(changes)
        if touched:
            old = rows.filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
            merged = upsert(old, changes, self.key).select(*old.columns).withColumn(BUCKET, self._bucket())
            self._write(merged, True)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Remove the rows with the given keys; returns the partitions rewritten.  A partition that loses all its rows is removed."""
        keys = self._keyed(keys.select(*self.key)).distinct()
        rows = self.spark.read.parquet(self.path)
        held = rows.filter(F.col(BUCKET).isin(self._touched(keys)))
        hit = sorted(r[0] for r in held.join(keys, self.key, "left_semi").select(BUCKET).distinct().collect())
        if hit:
            left = rows.filter(F.col(BUCKET).isin(hit)).join(keys, self.key, "left_anti")
            kept = {r[0] for r in left.select(BUCKET).distinct().collect()}
            self._write(left, True)
            for empty in set(hit) - kept:
                drop_table(self.spark, f"{self.path}/{BUCKET}={empty}")
        return hit
