"""Bounded captures over recorded rows, with event time in the place of the wall clock."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import duration_seconds
from emberlog.operators.filters import FilterSpec, scan_filter
from emberlog.operators.ordered import rank_rows
from emberlog.plans.envelope import retained_rows, sampled_summary, summary_struct

# How long a capture waits unless told otherwise.
WAIT_SECONDS = 30


def seconds_of(value: float | str | None, option: str) -> float | None:
    return duration_seconds(value, option) if isinstance(value, str) else value


def _later(time: Column, seconds: float) -> Column:
    return time + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def _state(logs: DataFrame) -> Column:
    """When the first row arrived and the latest time of any, `first` and `newest`: one read, one scalar subquery.

    Rows are beyond a deadline exactly if the latest time is, so nothing has to be counted for that.
    """
    return logs.agg(
        F.struct(F.min_by("timestamp", "seq").alias("first"), F.max("timestamp").alias("newest")).alias("state")
    ).scalar()


def capture_status(
    logs: DataFrame,
    timeout: float | str | None = None,
    capture: float | str | None = None,
    count: int | None = None,
    started=None,
) -> DataFrame:
    """One row: how many of the (matching) rows a capture takes and why it stops.

    `stop_reason` is `timeout` when no row came within `timeout` of `started`, `count` when
    `count` rows were taken, `capture` when the time after the first row ran out, else
    `exhausted`. The timeout is void once a row has matched.
    """
    timeout, capture = seconds_of(timeout, "timeout"), seconds_of(capture, "capture")
    if count is not None and count <= 0:
        raise ValueError("count must be a positive integer")
    first = _state(logs)["first"]
    inside = F.count("*") if capture is None else F.count_if(F.col("timestamp") <= _later(first, capture))
    totals = logs.agg(
        F.count("*").alias("_all"), inside.alias("_inside"), F.min_by("timestamp", "seq").alias("_first")
    )
    late = _too_late(F.col("_first"), logs, timeout, started)
    reason = _reason(late, F.col("_inside"), F.col("_all") > F.col("_inside"), capture, count)
    most = F.col("_inside") if count is None else F.least("_inside", F.lit(count))
    return totals.select(F.when(late, 0).otherwise(most).cast("long").alias("captured"), reason.alias("stop_reason"))


def _too_late(first: Column, logs: DataFrame, timeout: float | None, started) -> Column:
    """Whether no row came within `timeout` of the start."""
    if timeout is None:
        return F.lit(False)
    if started is None:
        raise ValueError("timeout needs the time the capture started")
    begun = F.lit(started).cast(logs.schema["timestamp"].dataType)
    return first.isNull() | (first > _later(begun, timeout))


def _reason(late: Column, inside: Column, beyond: Column, capture: float | None, count: int | None) -> Column:
    reason = F.when(late, "timeout")
    if count is not None:
        reason = reason.when(inside >= count, "count")
    if capture is not None:
        reason = reason.when(beyond, "capture")
    return reason.otherwise("exhausted")


def bounded_capture(
    logs: DataFrame,
    timeout: float | str | None = None,
    capture: float | str | None = None,
    count: int | None = None,
    started=None,
) -> DataFrame:
    """The rows such a capture takes, each with the `stop_reason` (see `capture_status`).

    One state of the whole input says when the time runs out and whether rows came after that;
    how many rows there are inside comes with their numbers, which only `count` asks for.
    """
    timeout, capture = seconds_of(timeout, "timeout"), seconds_of(capture, "capture")
    if count is not None and count <= 0:
        raise ValueError("count must be a positive integer")
    rows = logs.withColumn("_state", _state(logs))
    first, newest = F.col("_state")["first"], F.col("_state")["newest"]
    if capture is not None:
        rows = rows.where(F.col("timestamp") <= _later(first, capture))
    inside = F.lit(0)
    if count is not None:
        rows, inside = rank_rows(rows, F.col("seq"), limit=count, total="_inside").drop("rank"), F.col("_inside")
    late = _too_late(first, logs, timeout, started)
    beyond = F.lit(False) if capture is None else newest > _later(first, capture)
    rows = rows.withColumn("stop_reason", _reason(late, inside, beyond, capture, count))
    return rows.where("stop_reason <> 'timeout'").drop("_state", "_inside")


def capture_report(
    logs: DataFrame,
    spec: FilterSpec | None = None,
    count: int | None = None,
    timeout: float = WAIT_SECONDS,
    started=None,
    threshold: int | None = None,
    k: int | None = None,
) -> DataFrame:
    """One row: captured, requested, stopped_by, truncated, summary, entries or head and tail.

    Takes the matching rows within `timeout` seconds of `started`, by default of the first row
    of all: all of them, or the first `count`. `stopped_by` is `count`, else `timeout` if rows
    went on arriving after that, else `exhausted`. Rows are shown as `threshold` and `k` ask
    (see `sampled_summary`).
    """
    if count is not None and count <= 0:
        raise ValueError(f"count must be a positive integer, got {count}")
    state = _state(logs)
    begun = state["first"] if started is None else F.lit(started).cast(logs.schema["timestamp"].dataType)
    deadline = _later(begun, timeout)
    matching = scan_filter(logs, spec or FilterSpec(), mode="live").where(F.col("timestamp") <= deadline)
    taken = retained_rows(matching, count)
    answer = summary_struct(sampled_summary(taken, None, threshold, k, False)).withColumnRenamed("count", "captured")
    went_on = state["newest"] > deadline
    return answer.withColumns(
        {
            "requested": F.lit(count).cast("long"),
            "stopped_by": F.when(F.col("captured") >= F.lit(count), "count").when(went_on, "timeout").otherwise("exhausted"),
        }
    )
