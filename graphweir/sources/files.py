"""Files, directories and documents, read by Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.functions.text import extension, language_of, wanted_path
from graphweir.sources.fetch import get

# What counts as a document.
DOCUMENT_EXTENSIONS = ("md", "markdown", "rst", "txt", "html", "htm", "xml", "json", "yaml", "yml")
MOST_BYTES = 1_000_000


def file_tree(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    """path, name, extension, language, size of the wanted files below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    prefix = "^(file:)?/*" + root.split("://")[-1].strip("/") + "/"
    found = found.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), prefix, "")).filter(wanted_path(F.col("path")))
    if most_bytes is not None:
        found = found.filter(F.col("size") <= most_bytes)
    return found.select("path", F.substring_index("path", "/", -1).alias("name"), extension(F.col("path")).alias("extension"), language_of(F.col("path")).alias("language"), "size")


def row_places() -> Column:
    """File and row number of each row of a Parquet table: the same whenever, and in whatever partitions, its files are read."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def directories(files: DataFrame) -> DataFrame:
    """Distinct parent prefixes of the paths."""
    parts = F.split("path", "/")
    each = files.select(parts.alias("p")).filter(F.size("p") > 1).select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"))
    return each.select(F.array_join(F.slice("p", 1, F.col("n")), "/").alias("path")).distinct()


def texts(spark: SparkSession, root: str, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS) -> DataFrame:
    """path, text, n_chars of the files with one of the extensions; bad bytes are replaced."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = found.filter(extension(F.col("path")).isin(*extensions))
    return found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).withColumn("n_chars", F.length("text"))


def fetched_documents(urls: DataFrame, url_col: str = "url", timeout: float = 30) -> DataFrame:
    """url, status, text of the documents that a table of urls names, requested where the rows are; a missing one has a null text."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = [get(u, timeout) for u in frame["url"]]
            yield pd.DataFrame({"url": frame["url"], "status": [s for s, _ in replies], "text": [t for _, t in replies]})

    return urls.select(F.col(url_col).alias("url")).filter("url is not null").distinct().mapInPandas(ask, "url string, status int, text string")


def document_nodes(fetched: DataFrame) -> DataFrame:
    """Document properties of fetched urls: name, source, content (cut) and its whole length; failures are dropped."""
    name = F.coalesce(F.nullif(F.substring_index("url", "/", -1), F.lit("")), F.lit("remote_doc"))
    node = chunk_node(F.col("text"))
    return fetched.filter("status = 200").select(name.alias("name"), F.col("url").alias("source"), node["content"].alias("content"), node["full_length"].alias("content_length"), F.lit("remote").alias("type"))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_no, title, content) of ``SECTION:`` / ``CONTENT:`` lines; a section runs to the next."""
    from pyspark.sql import Window

    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line"))
    head = F.startswith("line", F.lit("SECTION:"))
    numbered = lines.withColumn("section_no", F.sum(head.cast("int")).over(Window.partitionBy("id").orderBy("n"))).filter("section_no > 0")
    body = F.when(head, None).otherwise(F.regexp_replace("line", "^CONTENT:\\s*", ""))
    grouped = numbered.groupBy("id", "section_no").agg(
        F.max(F.when(head, F.trim(F.substr("line", F.lit(9))))).alias("title"),
        F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("n", body.alias("b"))))).alias("parts"),
    )
    return grouped.select(F.col("id").alias(id_col), "section_no", "title", F.trim(F.array_join(F.transform("parts", lambda p: p["b"]), "\n")).alias("content"))


def chunk_node(text, most: int = 10_000):
    """content (cut to ``most`` characters) and the length of the whole."""
    return F.struct(F.substring(text, 1, most).alias("content"), F.length(text).alias("full_length"))
