"""The event pipeline as streams that also run over finished tables (trigger availableNow)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphweir.plans.durable import drop_table, shared_dir
from graphweir.plans.observed import Progress

# Failures that lock an account, and for how many seconds.
MOST_FAILURES, LOCK_SECONDS = 5, 300
#: An event type and the types it also counts as, as subclasses do.
KINDS = {"purchase": ("user_interaction", "telemetry"), "click": ("user_interaction",), "view": ("user_interaction",), "signup": ("user_interaction", "config"), "error": ("system", "logging")}


def stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A Parquet table (one file or a folder of files) as a stream, with the schema of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    # a pattern, because the file source takes a plain path to be a folder
    head, _, tail = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{head}/[{tail[0]}]{tail[1:]}")


def run(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream until its input is used up; its output is a table in the shared folder.

    A complete result is written beside the one of the batch before, which is there until the next has been
    written whole: a failure in between loses nothing, and a batch that is run again replaces its own.
    """
    spark, last = rows.sparkSession, {}
    base = f"{shared_dir(spark)}/graphweir/{name}-{uuid.uuid4().hex}"
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", base + "/state").trigger(availableNow=True)

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out-{epoch}")
        last["path"] = f"{base}/out-{epoch}"
        drop_table(batch.sparkSession, f"{base}/out-{epoch - 2}")

    if mode == "append":
        query = writer.format("parquet").option("path", base + "/out").start()
        last["path"] = base + "/out"
    else:
        query = writer.foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(last["path"]) if last else spark.createDataFrame([], rows.schema)


def routed(rows: DataFrame, kinds: dict[str, tuple[str, ...]] = KINDS) -> DataFrame:
    """A copy of each event for its type and for each type that it also counts as."""
    table = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.array_prepend(F.coalesce(F.try_element_at(table, F.col("event_type")), F.array().cast("array<string>")), F.col("event_type"))
    return rows.withColumn("channel", F.explode(own))


def subscribed(rows: DataFrame, channel: str) -> DataFrame:
    """The events of a channel; ``*`` takes all."""
    return rows if channel == "*" else rows.filter(F.col("channel") == channel)


def fan_out(rows: DataFrame, name: str) -> str:
    """Runs a routed stream once for all channels; returns the path of a table partitioned by batch and channel.

    Each batch is written into a folder of its own, so a batch that is run again replaces what it wrote before.
    """
    base = f"{shared_dir(rows.sparkSession)}/graphweir/{name}-{uuid.uuid4().hex}"
    writer = rows.writeStream.option("checkpointLocation", base + "/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, epoch: put_batch(batch, epoch, base + "/out")).start().awaitTermination()
    return base + "/out"


def put_batch(batch: DataFrame, epoch: int, path: str) -> None:
    batch.write.mode("overwrite").partitionBy("channel").parquet(f"{path}/batch={epoch}")


def received(spark: SparkSession, path: str, channel: str, columns: str) -> DataFrame:
    """What the subscriber of a channel gets of a fanned-out stream with the given columns; only that channel's folders are read."""
    try:
        rows = spark.read.schema(f"{columns}, batch long, channel string").option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as e:  # no batch yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)
    return rows.filter(F.col("channel") == channel).drop("batch", "channel")


def observed(rows: DataFrame, name: str, progress: Progress, **counts) -> DataFrame:
    """Runs a stream to its end while ``progress`` follows it; its output is a table in the shared folder."""
    spark = rows.sparkSession
    spark.streams.addListener(progress)
    try:
        out = run(rows.observe(progress.name, *[c.alias(k) for k, c in counts.items()]), name)
        if not progress.ended.wait(60):
            raise TimeoutError("the stream's end was not announced")
    finally:
        spark.streams.removeListener(progress)
    return out


def latest(rows: DataFrame, name: str, kept: int = 50) -> DataFrame:
    """The ``kept`` newest events of a stream: each batch makes a new view of the one before and its own rows.

    Only the last two views are there; the one before the last serves a batch that is run again.
    """
    spark, last = rows.sparkSession, {}
    base = f"{shared_dir(spark)}/graphweir/{name}-{uuid.uuid4().hex}"

    def step(batch: DataFrame, epoch: int) -> None:
        both = batch if epoch == 0 else batch.sparkSession.read.schema(batch.schema).parquet(f"{base}/view-{epoch - 1}").unionByName(batch)
        both.orderBy(F.desc("ts"), F.desc("event_id")).limit(kept).write.mode("overwrite").parquet(f"{base}/view-{epoch}")
        drop_table(batch.sparkSession, f"{base}/view-{epoch - 2}")
        last["path"] = f"{base}/view-{epoch}"

    rows.writeStream.option("checkpointLocation", base + "/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(last["path"]) if last else spark.createDataFrame([], rows.schema)


def recent(rows: DataFrame, kept: int = 50, shown: int = 10) -> DataFrame:
    newest = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(kept)
    return newest.orderBy(F.desc("ts"), F.desc("event_id")).limit(shown)


def attempt(failures: int, locked_until: float, at: float, failed: bool) -> tuple[int, float, bool]:
    """The state after one login attempt, and whether this attempt locked the account.

    An attempt while locked changes nothing; an expired lock is lifted first; a success
    resets; the last allowed failure locks.
    """
    if locked_until > at:
        return failures, locked_until, False
    if locked_until:
        failures, locked_until = 0, 0.0
    if not failed:
        return 0, 0.0, False
    failures += 1
    if failures >= MOST_FAILURES:
        return failures, at + LOCK_SECONDS, True
    return failures, 0.0, False


LOCKS = "user_id long, locked_at double, locked_until double"


def lockouts(attempts: DataFrame) -> DataFrame:
    """(user_id, locked_at, locked_until) of (user_id, at, failed) rows, ``at`` in seconds.

    Rows are sorted within their partition and streamed through one state at a time, so a
    user with any number of attempts needs no more memory than one with few.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, (0, 0.0)
        for frame in frames:
            out = []
            for u, at, failed in zip(frame["user_id"], frame["at"], frame["failed"], strict=True):
                if u != user:
                    user, state = u, (0, 0.0)
                *state, locked = attempt(*state, at, failed)
                if locked:
                    out.append((u, at, state[1]))
            yield pd.DataFrame(out, columns=["user_id", "locked_at", "locked_until"]).astype({"user_id": "int64", "locked_at": "float64", "locked_until": "float64"})

    ordered = attempts.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return ordered.select("user_id", "at", "failed").mapInPandas(scan, LOCKS)


class Lockouts(StatefulProcessor):
    """A user's failures and lock, in event time.

    There is a state only while there are failures since the last success or lock; a timer at the lock's end removes that of a locked user.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.login = handle.getValueState("login", "failures int, locked_until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = (self.login.get() if self.login.exists() else None) or (0, 0.0), []
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])  # what one batch has of one user
        for at, failed in frame[["at", "failed"]].itertuples(index=False):
            *now, locked = attempt(int(now[0]), float(now[1]), float(at), bool(failed))
            if locked:
                out.append((key[0], float(at), now[1]))
        self._keep(int(now[0]), float(now[1]), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["user_id", "locked_at", "locked_until"]).astype({"user_id": "int64", "locked_at": "float64", "locked_until": "float64"})

    def _keep(self, failures: int, until: float, watermark: int) -> None:
        ends = math.ceil(until * 1000)
        for timer in list(self.handle.listTimers()):
            if timer != ends:
                self.handle.deleteTimer(timer)
        if failures and (not ends or ends > watermark):
            self.login.update((failures, until))
            if ends:
                self.handle.registerTimer(ends)
        elif self.login.exists():
            self.login.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.login.clear()  # the lock has ended
        return iter([])

    def close(self) -> None:
        pass


def lockout_stream(attempts: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a stream, in event time, with a state for each user that goes with a success or the lock's end.

    Attempts are ordered by time within a batch, and batches are taken as they come; attempts that are older than the watermark (``late`` behind
    the newest one) are dropped.  States lie in RocksDB, which the session is set to.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = attempts.withColumn("event_time", F.timestamp_micros((F.col("at") * 1e6).cast("bigint"))).withWatermark("event_time", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Lockouts(), LOCKS, "append", "eventTime")


def windowed_counts(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events by type and event-time window, with a watermark for late ones."""
    w = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def progress(done, total, base: float, share: float):
    """Percent of a stage that goes from ``base`` to ``base + share``."""
    return F.lit(base) + F.lit(share) * F.coalesce(F.try_divide(done, total), F.lit(0.0))
