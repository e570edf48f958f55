"""Pairing intervals over live rows."""

from __future__ import annotations

import posixpath
import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberlog.functions import duration_seconds
from emberlog.operators.filters import FilterSpec, signpost_filter
from emberlog.operators.limits import limit_n
from emberlog.operators.signposts import pairing_events, pairing_state
from emberlog.plans.signpost_report import SignpostReport, report_of
from emberlog.streaming import versions
from emberlog.streaming.batches import CARRIED, batch_path, numbered
from emberlog.streaming.capture import POLL_SECONDS

# Where the rows of a batch lie: events that are settled, and begins that are still open.
SETTLED, OPEN = "settled", "open"


def _open_path(path: str, batch_id: int) -> str:
    return posixpath.join(batch_path(path, batch_id), f"part={OPEN}")


def _table(spark: SparkSession, path: str, version: versions.Version) -> DataFrame:
    """Classified events of all whole batches, with `batch_id` and `part`."""
    schema = StructType.fromJson(version.note["schema"]).add("batch_id", "long").add("part", "string")
    return spark.read.schema(schema).parquet(path).where(F.col("batch_id") <= version.batch_id)


def open_begins(spark: SparkSession, path: str, version: versions.Version) -> DataFrame:
    """The begins still open after the version's batch."""
    table = _table(spark, path, version)
    return table.where((F.col("batch_id") == version.batch_id) & (F.col("part") == OPEN)).drop("batch_id", "part")


def signposts_batch(batch: DataFrame, batch_id: int, path: str, ttl: float | str | None = None, **note) -> None:
    """Pair one batch with the begins still open, and write what that settles and what stays open.

    The open begins after a batch are a generation, in a folder of their own; only those of the
    last two batches are kept, so what is stored grows with the input. With `ttl` (seconds or
    `5m`), a begin that is so much older than the newest event seen is given up: it stays in the
    answer as an open interval, and its end, should it still come, is an orphan.

    A batch that a version covers is whole and is not done again; any other starts from the
    version before, and its own version, with `note`, is written last.
    """
    spark = batch.sparkSession
    last = versions.latest(spark, path)
    if last is not None and batch_id <= last.batch_id:
        return
    before = last.note if last is not None else {}
    rows = pairing_events(numbered(batch, before.get("next", 0))).drop("arrival").withColumn("_arrival", F.col("seq"))
    if last is not None:
        rows = rows.unionByName(open_begins(spark, path, last).drop("state", "end").withColumn("_arrival", F.lit(CARRIED)))
    states = pairing_state(rows, order="_arrival").drop("_arrival")
    stays = F.col("state") == "in_flight"
    newest = before.get("newest")
    if ttl is not None:
        seconds = duration_seconds(ttl, "ttl") if isinstance(ttl, str) else ttl
        seen = rows.agg(F.max(F.unix_micros(F.col("timestamp").cast("timestamp")))).head()[0]
        newest = max((x for x in (newest, seen) if x is not None), default=None)
        if newest is not None:
            kept_from = newest - round(seconds * 1_000_000)
            stays = stays & (F.unix_micros(F.col("timestamp").cast("timestamp")) >= kept_from)
    told = states.withColumn("part", F.when(stays, OPEN).otherwise(SETTLED))
    told.write.mode("overwrite").partitionBy("part").parquet(batch_path(path, batch_id))
    if "seq" not in batch.columns:
        taken = spark.read.schema(states.schema).parquet(batch_path(path, batch_id)).agg(F.max("seq")).head()[0]
        note |= {"next": max(before.get("next", 0), (-1 if taken is None else taken) + 1)}
    says = {"schema": states.schema.jsonValue(), "newest": newest, "before": last.batch_id if last is not None else None}
    versions.publish(spark, path, batch_id, before | says | note)
    if before.get("before") is not None:
        versions.remove(spark, _open_path(path, before["before"]))


def stream_signposts(
    rows: DataFrame, path: str, checkpoint: str, ttl: float | str | None = None, **trigger
) -> StreamingQuery:
    """Pair begin and end events of a stream into the batch table at `path` (see `signposts_batch`)."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(lambda batch, batch_id: signposts_batch(batch, batch_id, path, ttl)).start()


def signposts_result(spark: SparkSession, path: str) -> DataFrame:
    """Classified events so far, as `pairing_state` gives them for the whole input."""
    version = versions.required(spark, path)
    table = _table(spark, path, version)
    return table.where((F.col("part") == SETTLED) | (F.col("batch_id") == version.batch_id)).drop("batch_id", "part")


class IntervalCapture(NamedTuple):
    stop_reason: str
    events: int
    report: SignpostReport


def capture_signposts(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    spec: FilterSpec | None = None,
    seconds: float | str = 10,
    most: int | None = None,
    full: bool = False,
    **trigger,
) -> IntervalCapture:
    """Pair live events until a bound is met, then report on the intervals.

    The bounds are `seconds` of wall-clock time and, if named, `most` begin and end events that
    pass the field filters. Both are kept in the versions of the batch table, when the capture
    began and how many events it has: one that is run again on its checkpoint goes on where it
    was, and one that had met its bound stays stopped. `stop_reason` is `count`, `time`, or
    `exhausted` where the stream ends by itself.
    """
    spark = rows.sparkSession
    seconds = duration_seconds(seconds, "seconds") if isinstance(seconds, str) else seconds
    if most is not None and most <= 0:
        raise ValueError("most must be a positive integer")
    known = versions.latest(spark, path)
    began = known.note["began"] if known is not None else time.time()

    def events_before(batch_id: int) -> int:
        last = versions.latest(spark, path)
        return last.note["events"] if last is not None and last.batch_id < batch_id else 0

    def take(batch: DataFrame, batch_id: int) -> None:
        last = versions.latest(spark, path)
        if last is not None and batch_id <= last.batch_id:
            return
        had = events_before(batch_id)
        if most is not None and had >= most:
            return
        found = pairing_events(signpost_filter(batch, spec or FilterSpec(), "live"))
        if most is not None:
            found = limit_n(numbered(found), most - had)
        signposts_batch(found, batch_id, path, began=began, events=had + found.count())

    def reason() -> str | None:
        last = versions.latest(spark, path)
        if most is not None and last is not None and last.note["events"] >= most:
            return "count"
        return "time" if time.time() - began >= seconds else None

    writer = rows.writeStream.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    stopped = reason()
    if stopped is None:
        query = writer.foreachBatch(take).start()
        try:
            while stopped is None and not query.awaitTermination(POLL_SECONDS):
                stopped = reason()
        finally:
            query.stop()
    last = versions.latest(spark, path)
    if last is None:
        # Nothing came at all: the report on no events, of the stream's own columns.
        none = spark.createDataFrame([], rows.schema)
        return IntervalCapture(stopped or "exhausted", 0, report_of(pairing_state(numbered(none)), full, "stream"))
    answer = report_of(signposts_result(spark, path), full, "stream")
    return IntervalCapture(stopped or reason() or "exhausted", last.note["events"], answer)
