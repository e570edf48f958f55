"""Pairing begin and end events into timed intervals, and statistics over them.

Events pair within (pid, name, id) in arrival order: an end closes the begin right before it,
a second begin replaces the first. So one look at the neighbouring event decides each row: one
window on the key, and ranges of the order for keys that have very many events.

Statistics start from a histogram, how often each duration occurs per name. Counts, sums, bounds
and the exact median all come from it, so events are paired once for a whole answer.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.times import duration_us, format_ms, ms_from_us
from emberlog.operators.filters import signposts_only
from emberlog.operators.ordered import with_neighbours

PAIRING_KEY = ("pid", "signpostName", "signpostID")

INTERVAL_COLUMNS = [
    "name", "subsystem", "category", "pid", "signpostID", "start", "end",
    "duration_us", "duration_ms", "message", "begin_seq",
]


def pairing_events(logs: DataFrame) -> DataFrame:
    """Begin and end events that carry a name and an id; nothing else takes part in pairing."""
    return logs.where(
        signposts_only()
        & F.col("signpostName").isNotNull()
        & F.col("signpostID").isNotNull()
        & F.col("signpostType").isin("begin", "end")
    )


def pairing_state(logs: DataFrame, order: str = "seq") -> DataFrame:
    """Classify every begin and end event.

    `state` is `completed` for a begin with its end (and for that end), `in_flight` for a
    begin still open, `overwritten` for a begin replaced by a later one, `orphan` for an end
    without a begin. Begins carry `end`, the time of their end event, when completed.
    """
    events = with_neighbours(
        pairing_events(logs),
        previous={"_previous_type": "signpostType"},
        following={"_next_type": "signpostType", "_next_time": "timestamp"},
        keys=PAIRING_KEY,
        order=order,
    )
    is_begin = F.col("signpostType") == "begin"
    state = (
        F.when(is_begin & F.col("_next_type").isNull(), "in_flight")
        .when(is_begin & (F.col("_next_type") == "end"), "completed")
        .when(is_begin, "overwritten")
        .when(F.col("_previous_type") == "begin", "completed")
        .otherwise("orphan")
    )
    return (
        events.withColumn("state", state)
        .withColumn("end", F.when(is_begin & (F.col("state") == "completed"), F.col("_next_time")))
        .drop("_previous_type", "_next_type", "_next_time")
    )


def intervals_of(states: DataFrame) -> DataFrame:
    """Intervals of already classified events: completed begins and open ones."""
    begins = states.where((F.col("signpostType") == "begin") & F.col("state").isin("completed", "in_flight"))
    lasted = duration_us(F.col("timestamp"), F.col("end"))
    return begins.select(
        F.col("signpostName").alias("name"),
        "subsystem",
        "category",
        "pid",
        "signpostID",
        F.col("timestamp").alias("start"),
        "end",
        lasted.alias("duration_us"),
        ms_from_us(lasted).alias("duration_ms"),
        "message",
        F.col("seq").alias("begin_seq"),
    )


def signpost_intervals(logs: DataFrame) -> DataFrame:
    """One row per interval; open ones have no end and no duration."""
    return intervals_of(pairing_state(logs))


def orphan_ends(logs: DataFrame) -> DataFrame:
    """End events with no begin before them."""
    return pairing_state(logs).where("state = 'orphan'").drop("state", "end")


def completed_union_open(completed: DataFrame, in_flight: DataFrame) -> DataFrame:
    return completed.unionByName(in_flight)


def key_of(columns: tuple[str, ...]) -> Column:
    """Grouping columns as one that is never null, so that null keys join like any other.

    It also keeps the optimizer from inferring `IS NOT NULL` filters for one side of a join
    only, after which the two sides no longer share a shuffle.
    """
    return F.struct(*columns) if columns else F.lit(0)


def p50(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact median of a BIGINT column per key, as `low` and `high`: the middle two values.

    Both are the same value for odd counts. A sort or a value map per key would hold a hot
    key in one task, so equal values are counted first, and the middle is then found from
    coarse value ranges down to fine ones: only the two ranges around it are opened.
    """
    known = df.where(F.col(value).isNotNull()).select(
        key_of(keys).alias("_key"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("_value")
    )
    middle = middle_of(known.groupBy("_key", "_value").agg(F.count("*").alias("_rows")))
    return middle.select(*[F.col("_key")[name].alias(name) for name in keys], "low", "high")


def middle_of(counted: DataFrame) -> DataFrame:
    """The middle two values per `_key`, as `low` and `high`, of values counted as (_value, _rows).

    Neither `_key` nor `_value` may be null. The three readers of `counted` get no filters of
    their own and share one shuffle. Keys without rows have nulls or are left out.
    """
    counted = counted.select(
        "_key", "_value", "_rows", F.shiftright("_value", 40).alias("_coarse"), F.shiftright("_value", 20).alias("_fine")
    )

    def located(counts: DataFrame, inside: list[str], along: str) -> DataFrame:
        """Keep the ranges that hold a middle row, with the number of rows before each."""
        window = Window.partitionBy("_key", *inside).orderBy(along)
        before = F.col("_start") + F.sum("_rows").over(
            window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ) - F.col("_rows")
        placed = counts.withColumn("_start", before)
        return placed.where("_start < _upper and _start + _rows >= _lower").drop("_rows")

    coarse = counted.groupBy("_key", "_coarse").agg(F.sum("_rows").alias("_rows"))
    total = F.sum("_rows").over(Window.partitionBy("_key"))
    coarse = coarse.withColumn("_total", total).select(
        "_key",
        "_coarse",
        "_rows",
        F.expr("(_total + 1) div 2").alias("_lower"),
        F.expr("_total div 2 + 1").alias("_upper"),
        F.lit(0).cast("long").alias("_start"),
    )
    coarse = located(coarse, [], "_coarse")
    fine = counted.groupBy("_key", "_coarse", "_fine").agg(F.sum("_rows").alias("_rows"))
    fine = located(fine.join(coarse, ["_key", "_coarse"]), ["_coarse"], "_fine")
    values = counted.join(fine, ["_key", "_coarse", "_fine"])
    window = Window.partitionBy("_key", "_coarse", "_fine").orderBy("_value")
    until = F.col("_start") + F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = values.withColumn("_until", until).withColumn("_from", F.col("_until") - F.col("_rows"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_from") < F.col(rank)) & (F.col(rank) <= F.col("_until")), F.col("_value")))

    return values.groupBy("_key").agg(at("_lower").alias("low"), at("_upper").alias("high"))


SUMMARY_COLUMNS = ["name", "subsystem", "category", "count", "in_flight", "min_ms", "p50_ms", "max_ms", "total_ms"]


def duration_histogram(intervals: DataFrame) -> DataFrame:
    """Per name and duration: `_rows`, and the `_first` and `_last` interval that lasted as long.

    Open intervals are counted in a row of their own (`_open`, value 0). What many names share, a
    key that is never null, keeps readers of the histogram from filtering it each their own way.
    """
    told = intervals.select(
        key_of(("name",)).alias("_key"),
        F.coalesce("duration_us", F.lit(0)).alias("_value"),
        F.col("duration_us").isNull().alias("_open"),
        F.struct("start", "begin_seq", "subsystem", "category", "message").alias("_cell"),
    )
    return told.groupBy("_key", "_value", "_open").agg(
        F.count("*").alias("_rows"), F.min("_cell").alias("_first"), F.max("_cell").alias("_last")
    )


def _name_statistics(intervals: DataFrame) -> DataFrame:
    """All about each name, `last_args` included, from one histogram.

    Both readers of the histogram ask for all of it, so they share its one shuffle, and the
    pairing below it is done once.
    """
    histogram = duration_histogram(intervals)
    done = F.col("_first").isNotNull() & F.col("_last").isNotNull() & ~F.col("_open")
    middle = middle_of(histogram.select("_key", "_value", F.when(done, F.col("_rows")).otherwise(0).alias("_rows")))
    lasted = F.when(~F.col("_open"), F.col("_value"))
    stats = histogram.groupBy("_key").agg(
        F.sum("_rows").alias("count"),
        F.sum(F.when(F.col("_open"), F.col("_rows")).otherwise(0)).alias("in_flight"),
        ms_from_us(F.min(lasted)).alias("min_ms"),
        ms_from_us(F.max(lasted)).alias("max_ms"),
        ms_from_us(F.sum(lasted * F.col("_rows"))).alias("total_ms"),
        F.min("_first").alias("_origin"),
        F.coalesce(F.nullif(F.max("_last")["message"], F.lit("")), F.lit("-")).alias("last_args"),
    )
    p50_ms = F.round((F.col("low") + F.col("high")) / F.lit(2.0)) / F.lit(1000.0)
    return stats.join(middle, "_key", "left").withColumns(
        {
            "name": F.col("_key.name"),
            "subsystem": F.col("_origin.subsystem"),
            "category": F.col("_origin.category"),
            "p50_ms": p50_ms,
        }
    )


def signpost_summary(intervals: DataFrame) -> DataFrame:
    """Per name: counts, duration statistics in milliseconds, and the first origin seen.

    Statistics cover completed intervals and are null when there are none. The median is
    rounded to whole microseconds, ties away from zero; the others are whole already.
    """
    return _name_statistics(intervals).select(*SUMMARY_COLUMNS)


def summaries_by_total(summary: DataFrame) -> DataFrame:
    """Names ordered by total duration, then name, both descending."""
    return summary.orderBy(F.coalesce("total_ms", F.lit(0.0)).desc(), F.col("name").desc())


def intervals_by_start(intervals: DataFrame) -> DataFrame:
    """Intervals ordered by start; equal starts in arrival order.

    A range sort on both, so even a start shared by very many intervals spreads out.
    """
    return intervals.orderBy("start", "begin_seq")


def signpost_occurrences(intervals: DataFrame) -> DataFrame:
    """One row per interval, ordered by name and then in begin order.

    Flat rather than nested: a list per name would gather a hot name in one row.
    """
    ordered = intervals.orderBy("name", "start", "begin_seq")
    return ordered.select("name", "start", "begin_seq", "duration_ms", "message")


def _latest_message(moment: Column) -> Column:
    return F.coalesce(F.nullif(F.max_by("message", moment), F.lit("")), F.lit("-"))


def last_args(intervals: DataFrame) -> DataFrame:
    """Per name the message of its latest interval, `-` if that is empty."""
    return intervals.groupBy("name").agg(_latest_message(F.struct("start", "begin_seq")).alias("last_args"))


def totals_of(states: DataFrame) -> DataFrame:
    open_, done = F.col("state") == "in_flight", F.col("state") == "completed"
    begin = F.col("signpostType") == "begin"
    return states.agg(
        F.count_if(open_ | (done & begin)).alias("count"),
        F.count_if(open_).alias("in_flight"),
        F.count_if(F.col("state") == "orphan").alias("orphan_ends"),
        F.count_if(F.col("state") == "overwritten").alias("overwritten"),
    )


def signpost_totals(logs: DataFrame) -> DataFrame:
    """One row: intervals, open ones, orphaned ends, and begins that a later begin replaced."""
    return totals_of(pairing_state(logs))


def signpost_table(logs: DataFrame) -> DataFrame:
    """Display rows: name, count, p50, max, total, last arguments, in order of total time."""
    named = summaries_by_total(_name_statistics(signpost_intervals(logs)))

    def shown(column: str) -> Column:
        return format_ms(F.round(F.col(column) * 1000).cast("long"))

    return named.select(
        "name",
        "count",
        shown("p50_ms").alias("p50"),
        shown("max_ms").alias("max"),
        shown("total_ms").alias("total"),
        "last_args",
    )


def signpost_footer(logs: DataFrame) -> DataFrame:
    """One row for below the table: how many begins and ends were left unpaired."""
    return signpost_totals(logs).select("in_flight", "orphan_ends")
