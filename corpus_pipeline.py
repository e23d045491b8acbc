"""The corpus pipeline: quality classifier, exact dedup, near dedup, source mixing, packing.

Each stage works on all rows that the one before kept and returns the columns of documents,
but for the last, which returns the packed pieces.  Nulls, empty and very long texts,
repeated rows, empty tables and extra columns are handled as the operators' docstrings say;
extra columns of ``documents`` are carried through to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.llm import exact_dedup, mixing, ngram_join, packing, quality
from graphweir.plans.durable import ROW, durable, free_names, tagged
from graphweir.plans.session import table


def _chosen(docs: DataFrame, row: str, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs``, numbered in column ``row``, that ``decisions`` names."""
    return docs.join(decisions.select(F.col(ROW).alias(row)), row, "left_semi").drop(row)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose perplexity lies outside their language's quantiles."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the row with the smallest id."""
    rows, row = tagged(docs)
    return _chosen(rows, row, exact_dedup.exact_duplicates(rows, row_col=row).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the row with the smallest id."""
    rows, row = tagged(docs)
    return _chosen(rows, row, ngram_join.similarity_classes(rows, row_col=row).filter("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops, keeps or repeats documents so that sources meet their targets."""
    rows, row = tagged(docs)
    (copies,) = free_names(rows, "copies")
    times = mixing.mixed(rows, row_col=row).filter("copies > 0").select(F.col(ROW).alias(row), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copies))
    return rows.join(times, row).drop(row, copies)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into windows; a document that the mix repeats is packed as often."""
    return packing.with_checksum(packing.pack(docs))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]

#: SQL has no tokenizer, language model or balanced sampling; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
