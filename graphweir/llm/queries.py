"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphweir.llm import collocations, embedding_dedup, exact_dedup, fingerprint, language_id, line_dedup, mixing, ngram_join, packing, quality, sharding, url_filter, whitening
from graphweir.plans.durable import ROW
from graphweir.plans.session import table
from graphweir.sources.files import row_places


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_checksum(packing.pack(table(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.without_repeats(table(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents")).drop(ROW)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents")).drop(ROW)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_classes(table(spark, sf_dir, "embeddings")).drop(ROW)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop(ROW)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), with_digest=True).drop(ROW)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(ROW, row_places())
    return fingerprint.fingerprints(docs, row_col=ROW).drop(ROW)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_url_filter, op3_line_dedup, op4_sharding, op5_ngram_join, op6_embedding_dedup, op7_language_id, op8_mixing, op9_exact_dedup, op10_quality, op11_fingerprint, op12_whitening, op13_collocations)}
ORACLES = {"op4_sharding": sharding.SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_fingerprint": fingerprint.SQL, "op13_collocations": collocations.SQL}
