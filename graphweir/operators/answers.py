"""Data-flow paths out of written answers, by their headed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADS = ("source", "sink", "vulnerability", "issue", "description", "recommendation")


def _joined(kind: str) -> Column:
    lines = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", F.col("body").alias("b")))))
    return F.array_join(F.transform(lines, lambda x: x["b"]), "\n")


def flow_paths(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, path_no, source, sink, vulnerability_type, impact, description, recommendations, confidence).

    A line with a head and a colon begins a field, lines without one continue it, and each
    ``Source`` line begins a path.  A path needs a source, a sink, and a vulnerability or a
    description.  The impact is high or low if the answer speaks of impact and says so.
    """
    low = F.lower(F.col(text_col))
    impact = F.when(F.contains(low, F.lit("impact")) & F.contains(low, F.lit("high")), "high").when(F.contains(low, F.lit("impact")) & F.contains(low, F.lit("low")), "low").otherwise("medium")
    lines = answers.select(F.col(id_col).alias("id"), impact.alias("impact"), F.posexplode(F.split(text_col, "\n")).alias("n", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    head = F.lower(F.regexp_extract("line", rf"(?i)^({'|'.join(HEADS)})[^:]*:", 1))
    order = Window.partitionBy("id").orderBy("n")
    marked = lines.withColumn("head", F.nullif(head, F.lit(""))).withColumn("body", F.when(F.col("head").isNull(), F.col("line")).otherwise(F.trim(F.regexp_replace("line", "^[^:]*:", ""))))
    marked = marked.withColumn("kind", F.last("head", ignorenulls=True).over(order)).withColumn("kind", F.when(F.col("kind") == "issue", "vulnerability").otherwise(F.col("kind")))
    marked = marked.withColumn("path_no", F.sum((F.coalesce(F.col("head") == "source", F.lit(False))).cast("int")).over(order)).filter("path_no > 0")
    out = marked.groupBy("id", "path_no", "impact").agg(*[_joined(k).alias(k) for k in ("source", "sink", "vulnerability", "description", "recommendation")])
    out = out.filter("source <> '' and sink <> '' and (vulnerability <> '' or description <> '')")
    kind = F.when(F.col("vulnerability") == "", "Potential data flow vulnerability").otherwise(F.col("vulnerability"))
    recs = F.filter(F.transform(F.split("recommendation", "\n"), lambda r: F.regexp_replace(r, r"^-\s*", "")), lambda r: r != "")
    return out.select(F.col("id").alias(id_col), F.dense_rank().over(Window.partitionBy("id").orderBy("path_no")).alias("path_no"), "source", "sink", kind.alias("vulnerability_type"), "impact", "description", recs.alias("recommendations"), F.lit(0.6).alias("confidence"))
