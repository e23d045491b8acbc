"""Records fetched by key from a service, a request for each key that was not fetched before.

Two ways in.  ``KeyedRecords`` is a data source whose filter on ``id`` is pushed down: the keys of ``id = 'x'`` or ``id IN (...)``
become partitions of requests, and nothing else is asked for.  ``fetched`` takes a table of keys of any size: keys that the landing table
has are read from there, the others are requested where their partitions are, and land for the next run.

A url template names the key (``{id}``: a request for each key) or the key's page (``{page}``: the key without its last ``TAIL`` characters). A page is
JSON lines, one for each record, with the key as ``id``; it is requested once for all keys of it that are wanted.

A missing record (404) lands too, so that it is not asked for again; other failures are raised by the task, which Spark retries.
"""

from __future__ import annotations

import itertools
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

RECORD = "id string, status int, body string"
#: Keys of one partition of requests.
KEYS = 50
#: Characters of a key that its page's name lacks.
TAIL = 4
#: Replies that are put out together.
BATCH = 1000


def get(url: str, timeout: float = 30) -> tuple[int, str | None]:
    """Status and body of a url; a missing file or folder counts as 404.  Of a folder the visible files are read, as Spark's writers leave them."""
    path = urllib.request.url2pathname(urllib.parse.urlsplit(url).path) if url.startswith("file:") else None
    if path and os.path.isdir(path):
        names = sorted(n for n in os.listdir(path) if n[0] not in "._")
        return 200, "".join(open(os.path.join(path, n), encoding="utf-8", errors="replace").read() for n in names)  # noqa: SIM115
    if path and not os.path.exists(path):
        return 404, None
    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
            return getattr(reply, "status", 200) or 200, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        if e.code in (404, 410):
            return 404, None
        raise


def url_of(template: str, key: str) -> str:
    return template.replace("{id}", urllib.parse.quote(key, safe="")).replace("{page}", urllib.parse.quote(key[:-TAIL], safe=""))


def page(key: Column) -> Column:
    """The page of a key, as ``url_of`` has it."""
    return F.left(key, F.length(key) - TAIL)


def replies(template: str, keys: Iterable[str], timeout: float) -> Iterator[tuple[str, int, str | None]]:
    """id, status, body of each key. Keys of a page that come one after the other share a request, and one page is held at a time."""
    asked, held = None, {}
    for key in keys:
        url = url_of(template, key)
        if "{page}" not in template:
            yield key, *get(url, timeout)
            continue
        if url != asked:
            lines = (get(url, timeout)[1] or "").split("\n")
            asked, held = url, {json.loads(line)["id"]: line for line in lines if line.strip()}
        yield key, 200 if key in held else 404, held.get(key)


class KeyedRecords(DataSource):
    """id, status, body of the keys that a filter names.  Options: ``url`` with ``{id}`` in it, ``timeout`` in seconds, ``keys`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "keyed_records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["url"], float(self.options.get("timeout", "30")), int(self.options.get("keys", str(KEYS))))


class _Reader(DataSourceReader):
    def __init__(self, url: str, timeout: float, size: int):
        self.url, self.timeout, self.size, self.keys = url, timeout, size, None

    def pushFilters(self, filters):
        """Takes the filters on ``id``; several of them leave the keys that all name.  The others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                named = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.keys = [k for k in dict.fromkeys(named) if k is not None and (self.keys is None or k in self.keys)]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.keys is None:
            raise ValueError("keyed_records needs a filter id = ... or id IN (...), and spark.sql.python.filterPushdown.enabled")
        if "{page}" in self.url:
            pages: dict[str, list[str]] = {}
            for key in self.keys:
                pages.setdefault(key[:-TAIL], []).append(key)
            return [InputPartition(keys) for keys in pages.values()] or [InputPartition([])]
        return [InputPartition(self.keys[i : i + self.size]) for i in range(0, len(self.keys), self.size)] or [InputPartition([])]

    def read(self, partition: InputPartition):
        yield from replies(self.url, partition.value, self.timeout)


def records(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The service as a table, to be filtered by ``id``; take a new one for each set of keys, as Spark keeps a source's filters with it."""
    spark.dataSource.register(KeyedRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("keyed_records").option("url", url).options(**options).load()


def landed(spark: SparkSession, landing: str) -> DataFrame:
    """The records of the landing table, none where there is no table yet."""
    try:
        return spark.read.schema(RECORD).parquet(landing)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def fetched(ids: DataFrame, id_col: str, url: str, landing: str, valid: str | None = None, timeout: float = 30) -> DataFrame:
    """``ids`` with ``status`` and ``body`` of each row's record: nulls for keys that ``valid`` (a pattern) does not match, a null body for missing ones.

    Each distinct key, or each page that has such keys, is requested at most once, and only for keys that the landing table lacks.
    """
    spark = ids.sparkSession
    good = F.col(id_col).isNotNull() & (F.col(id_col).rlike(valid) if valid else F.lit(True))
    wanted = ids.filter(good).select(F.col(id_col).cast("string").alias("id")).distinct()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = replies(url, (key for frame in frames for key in frame["id"]), timeout)  # over all frames, as a page may lie in two
        while some := list(itertools.islice(found, BATCH)):
            yield pd.DataFrame(some, columns=["id", "status", "body"])

    missing = wanted.join(landed(spark, landing).select("id"), "id", "left_anti")
    if "{page}" in url:
        missing = missing.repartition(page(F.col("id"))).sortWithinPartitions(page(F.col("id")))
    missing.mapInPandas(ask, RECORD).write.mode("append").parquet(landing)
    known = landed(spark, landing).groupBy(F.col("id").alias("gw_key")).agg(F.first("status").alias("status"), F.first("body").alias("body"))  # a task that ran twice may have landed a key twice
    return ids.join(known, good & (F.col(id_col).cast("string") == F.col("gw_key")), "left").drop("gw_key")
