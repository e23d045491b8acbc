"""The audit log: canonical form, checksums, sealed lines, and the event query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "event_id string, event_type string, user_id string, component string, details map<string,string>, level string, timestamp timestamp, source_ip string, success boolean, resource_id string, session_id string, checksum string"
#: Timestamps keep their microseconds in a line.
OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
FIELDS = ["component", "event_id", "event_type", "level", "resource_id", "session_id", "source_ip", "success", "timestamp", "user_id"]


def canonical(row: dict[str, Column] | None = None) -> Column:
    """Version 1 of our canonical form: sorted fields as JSON, then sorted details as JSON.

    Timestamps are microseconds since the epoch, so the form does not depend on a time zone.
    """
    col = lambda c: (row or {}).get(c, F.col(c))
    fields = [(F.unix_micros(col(c)) if c == "timestamp" else col(c)).cast("string").alias(c) for c in FIELDS]
    details = F.array_sort(F.transform(F.map_entries(F.coalesce(col("details"), F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws("=", F.to_json(F.array(e["key"])), F.to_json(F.array(e["value"])))))
    return F.concat(F.lit("1"), F.to_json(F.struct(*fields)), F.array_join(details, ";"))


def with_checksum(events: DataFrame) -> DataFrame:
    return events.withColumn("checksum", F.sha2(canonical(), 256))


def lines(events: DataFrame, key: Column | None = None) -> DataFrame:
    """date and one JSON line per event, sealed as ``ENC:`` where a key is given."""
    text = F.to_json(F.struct(*[c for c in events.columns if c != "date"]), OPTIONS)
    sealed = text if key is None else F.concat(F.lit("ENC:"), F.regexp_replace(F.base64(F.aes_encrypt(text.cast("binary"), key)), r"\s", ""))
    return events.select(F.to_date("timestamp").alias("date"), sealed.alias("value"))


def parsed(raw: DataFrame, key: Column | None = None) -> DataFrame:
    """Events of JSON lines; sealed lines are opened with ``key``, lines that do not parse are skipped."""
    plain = F.col("value")
    if key is not None:
        opened = F.try_aes_decrypt(F.unbase64(F.substr("value", F.lit(5))), key).cast("string")
        plain = F.when(F.startswith("value", F.lit("ENC:")), opened).otherwise(plain)
    keep = [F.col("date")] if "date" in raw.columns else []
    # one row out of each: what filters ask of the fields later is not pushed below, where it would open and parse the line again
    opened_once = F.explode(F.array(F.from_json(plain, SCHEMA, OPTIONS)))
    return raw.select(*keep, opened_once.alias("e")).filter("e.event_id is not null").select(*[k for k in keep], "e.*")


def query_events(
    events: DataFrame, start: dt.datetime, end: dt.datetime, event_types: list[str] | None = None, user_id: str | None = None, component: str | None = None, level: str | None = None, resource_id: str | None = None, success: bool | None = None, verify: bool = True
) -> DataFrame:
    """Events from ``start`` to ``end``, both included, that pass the given filters, newest first.

    Where there is a ``date`` partition column, only the days of the range are read.  A
    missing ``success`` counts as true; events whose checksum is wrong are left out, those
    without one stay.
    """
    if "date" in events.columns:
        events = events.filter(F.col("date").between(F.lit(start.date()), F.lit(end.date())))
    events = events.filter(F.col("timestamp").between(F.lit(start), F.lit(end)))
    if event_types:
        events = events.filter(F.col("event_type").isin(event_types))
    for column, value in (("user_id", user_id), ("component", component), ("level", level), ("resource_id", resource_id)):
        events = events if value is None else events.filter(F.col(column) == value)
    if success is not None:
        events = events.filter(F.coalesce("success", F.lit(True)) == success)
    if verify:
        events = events.filter(F.col("checksum").isNull() | (F.col("checksum") == F.sha2(canonical(), 256)))
    # a sort reads its rows twice, first for its ranges: what passed is shuffled before, so that lines are opened once
    return events.hint("rebalance").orderBy(F.desc("timestamp"), F.desc("event_id"))


def write_log(events: DataFrame, path: str, key: Column | None = None) -> None:
    """Appends to a log of JSON lines, a folder per day."""
    lines(events, key).write.mode("append").partitionBy("date").text(path)


def read_log(spark, path: str, key: Column | None = None) -> DataFrame:
    return parsed(spark.read.schema("value string, date date").text(path), key)
