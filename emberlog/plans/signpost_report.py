"""The full answer about intervals."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.filters import FilterSpec, signpost_filter
from emberlog.operators.signposts import (
    intervals_of,
    pairing_state,
    signpost_occurrences,
    signpost_summary,
    summaries_by_total,
    totals_of,
)

# What to do about an answer without intervals, by mode.
HINTS = {
    "show": "No stored begin and end events pair up here; try a live capture.",
    "stream": "The capture saw no begin and end events that pair up; check the filters and run it longer.",
}


class SignpostReport(NamedTuple):
    """`header` is one row; `intervals` has a row per name; `occurrences` a row per interval.

    The three stay frames of their own, so a name with most of the rows is never one value.
    """

    header: DataFrame
    intervals: DataFrame
    occurrences: DataFrame | None


def signpost_report(
    logs: DataFrame, spec: FilterSpec | None = None, full: bool = False, mode: str = "show", scan: str = "replay"
) -> SignpostReport:
    """Pair the intervals passing the field filters and report on them.

    `scan="live"` adds the case-sensitive path test that live and historical scans have.
    """
    return report_of(pairing_state(signpost_filter(logs, spec or FilterSpec(), scan)), full, mode)


def report_of(states: DataFrame, full: bool = False, mode: str = "show") -> SignpostReport:
    """The report on events already paired, as the streaming pairing leaves them."""
    intervals = intervals_of(states)
    header = totals_of(states).withColumns(
        {
            "mode": F.lit(mode),
            "hint_code": F.when(F.col("count") == 0, F.lit("nothing_paired")),
            "hint": F.when(F.col("count") == 0, F.lit(HINTS[mode])),
        }
    )
    return SignpostReport(
        header,
        summaries_by_total(signpost_summary(intervals)),
        signpost_occurrences(intervals) if full else None,
    )
