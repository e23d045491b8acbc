"""A stored index of three-character runs for substring search.

Postings (gram, id) are written once, in partitions by a hash of the gram and sorted by it within files.  A search reads the partitions of its
pattern's grams, keeps the ids that have them all, and verifies the pattern on those rows' texts alone.  Patterns of fewer than three characters have no
gram; they scan all texts.

Grams are taken of the text in lower case, character by character and with one form of sigma, so that the same postings serve
searches in any case and in exact case: lower case of a whole text depends on a letter's neighbours, that of a character does not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "gw_bucket"
SIZE = 3


def folded(text: Column) -> Column:
    return F.translate(F.array_join(F.transform(F.split(text, ""), F.lower), ""), "ς", "σ")


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a folded text; none of a shorter or null one."""

    def runs(c: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(c) - SIZE), lambda i: F.concat(*[F.get(c, i + k) for k in range(SIZE)]))
        return F.when(F.size(c) >= SIZE, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    # a lambda variable, so that the characters are split once
    return F.element_at(F.transform(F.array(F.split(folded(F.coalesce(text, F.lit(""))), "")), runs), 1)


def build(rows: DataFrame, id_col: str, columns: list[str], path: str, buckets: int = 64) -> None:
    """Write the postings of the texts in ``columns``; a gram that very many rows have is split over several files."""
    each = reduce(DataFrame.unionByName, [rows.select(F.col(id_col).alias("id"), F.explode(grams(F.col(c))).alias("gram")) for c in columns])
    postings = each.distinct().withColumn(BUCKET, F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    postings.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "gram").write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def _hit(columns: list[str], pattern: str, exact_case: bool) -> Column:
    found = [F.contains(F.col(c), F.lit(pattern)) if exact_case else F.contains(F.lower(c), F.lower(F.lit(pattern))) for c in columns]
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in found])


def candidates(rows: DataFrame, path: str, pattern: str, buckets: int = 64) -> DataFrame | None:
    """id of the rows that have all grams of ``pattern``; None if it has none."""
    gram = F.explode(grams(F.lit(pattern)))
    wanted = rows.sparkSession.range(1).select(gram.alias("gram")).select("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("b")).collect()
    if not wanted:
        return None
    postings = rows.sparkSession.read.schema(f"id {rows.schema['id'].dataType.simpleString()}, gram string, {BUCKET} int").parquet(path)
    near = postings.filter(F.col(BUCKET).isin(sorted({r["b"] for r in wanted})) & F.col("gram").isin([r["gram"] for r in wanted]))
    return near.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def search(rows: DataFrame, id_col: str, columns: list[str], path: str, patterns: list[str], exact_case: bool = True, buckets: int = 64) -> DataFrame:
    """The rows of which one of ``columns`` holds one of ``patterns``.  ``rows`` is the table that was indexed; ids may repeat or be null."""
    hit = reduce(lambda a, b: a | b, [_hit(columns, p, exact_case) for p in patterns])
    ids = rows.select(F.col(id_col).alias("id"))
    found = [candidates(ids, path, p, buckets) for p in patterns]
    if any(f is None for f in found):
        return rows.filter(hit)
    near = reduce(DataFrame.unionByName, found).distinct().withColumnRenamed("id", "gw_id")
    return rows.join(near, F.col(id_col).eqNullSafe(F.col("gw_id")), "left_semi").filter(hit)
