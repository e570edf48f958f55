"""Captures of live rows that end by themselves."""

import time
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from emberlog.operators.limits import limit_n
from emberlog.plans.capture import seconds_of
from emberlog.streaming.batches import batch_path, numbered

POLL_SECONDS = 0.2


class Capture(NamedTuple):
    stop_reason: str
    captured: int


def taken_before(rows: DataFrame, path: str) -> dict[int, int]:
    """Rows per batch in the batch table, of which there may be none yet."""
    try:
        counted = rows.sparkSession.read.parquet(path).groupBy("batch_id").count().collect()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return {}
    return {row.batch_id: row["count"] for row in counted}


def capture_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    timeout: float | str | None = None,
    capture: float | str | None = None,
    count: int | None = None,
    **trigger,
) -> Capture:
    """Write matching rows of a stream to the batch table at `path` until a bound is met.

    Bounds are those of `bounded_capture`, by the wall clock: no row within `timeout`,
    `capture` after the first row, or `count` rows. Only the counters live in the driver, and
    they start from the batch table: a capture run again on its checkpoint counts the rows it
    has. Its clocks start anew, and rows it has count as a first row at the start.
    """
    timeout, capture = seconds_of(timeout, "timeout"), seconds_of(capture, "capture")
    if count is not None and count <= 0:
        raise ValueError("count must be a positive integer")
    taken = taken_before(rows, path)
    first_at = [time.monotonic()] if any(taken.values()) else []

    def take(batch: DataFrame, batch_id: int) -> None:
        before = sum(n for other, n in taken.items() if other != batch_id)
        if count is not None and before >= count:
            return
        found = numbered(batch) if count is None else limit_n(numbered(batch), count - before)
        found.write.mode("overwrite").parquet(batch_path(path, batch_id))
        taken[batch_id] = batch.sparkSession.read.parquet(batch_path(path, batch_id)).count()
        if taken[batch_id] and not first_at:
            first_at.append(time.monotonic())

    def reason(started: float) -> str | None:
        if count is not None and sum(taken.values()) >= count:
            return "count"
        if capture is not None and first_at and time.monotonic() - first_at[0] >= capture:
            return "capture"
        if timeout is not None and not first_at and time.monotonic() - started >= timeout:
            return "timeout"
        return None

    writer = rows.writeStream.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    started = time.monotonic()
    query = writer.foreachBatch(take).start()
    try:
        while not query.awaitTermination(POLL_SECONDS):
            stopped_by = reason(started)
            if stopped_by is not None:
                query.stop()
                return Capture(stopped_by, sum(taken.values()))
    finally:
        query.stop()
    return Capture(reason(started) or "exhausted", sum(taken.values()))
