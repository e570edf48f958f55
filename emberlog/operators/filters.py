"""Row filters: single predicates, their combination, and the whole-scan filter.

A predicate is a boolean Column over the canonical log columns that is never null: it says
`c IS NOT NULL AND ...`, which the optimizer pushes to the Parquet scan in both halves, while
a COALESCE around the comparison would stay above it. Field predicates compare raw columns
(`level IN (...)`, `subsystem LIKE 'p%'`) for the same reason. Regular expressions are tested
last, over what the cheap predicates left.
"""

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.levels import levels_at_least
from emberlog.functions.times import duration_seconds
from emberlog.schema import SIGNPOST_EVENT


def _when_set(column: str, condition: Column) -> Column:
    return F.col(column).isNotNull() & condition


# --- single predicates -------------------------------------------------------------------


def process_ci(name: str, case_sensitive: bool = False) -> Column:
    process = F.col("processName")
    same = process == name if case_sensitive else F.lower(process) == F.lower(F.lit(name))
    return _when_set("processName", same)


def process_path_suffix(names: list[str]) -> Column:
    """The binary's path ends in `/name`, for any of the names (case matters)."""
    path = F.col("processImagePath")
    return _when_set("processImagePath", any_of([path.endswith(f"/{name}") for name in names]))


def pid_eq(pid: int) -> Column:
    return _when_set("pid", F.col("pid") == pid)


def subsystem_exact(subsystem: str) -> Column:
    return _when_set("subsystem", F.col("subsystem") == subsystem)


def subsystem_prefix(prefixes: list[str]) -> Column:
    """Plain text prefix, without regard to dots: `com.a` also takes `com.ab`."""
    return _when_set("subsystem", any_of([F.col("subsystem").startswith(prefix) for prefix in prefixes]))


def category_eq(names: list[str]) -> Column:
    return _when_set("category", F.col("category").isin(names))


def min_level(level: str) -> Column:
    return _when_set("level", F.col("level").isin(levels_at_least(level)))


def signposts_only() -> Column:
    return _when_set("eventType", F.col("eventType") == SIGNPOST_EVENT)


def _flagged(pattern: str, case_sensitive: bool) -> str:
    return pattern if case_sensitive else f"(?iu){pattern}"


def grep(pattern: str, case_sensitive: bool = False) -> Column:
    """The message contains a match of the regular expression."""
    return _when_set("message", F.col("message").rlike(_flagged(pattern, case_sensitive)))


def exclude_grep(pattern: str, case_sensitive: bool = False) -> Column:
    return ~grep(pattern, case_sensitive)


# --- combinations ------------------------------------------------------------------------


def not_pred(predicate: Column) -> Column:
    """The opposite; a predicate of the caller's own that is null counts as not met."""
    return ~F.coalesce(predicate, F.lit(False))


def any_of(predicates: list[Column]) -> Column:
    """OR; an empty group lets everything pass."""
    return reduce(lambda a, b: a | b, predicates) if predicates else F.lit(True)


def filter_chain(predicates: list[Column]) -> Column:
    """AND; an empty chain lets everything pass."""
    return reduce(lambda a, b: a & b, predicates) if predicates else F.lit(True)


# --- parameters --------------------------------------------------------------------------


def _names(value) -> tuple[str, ...]:
    """Comma-separated text or a list, as trimmed non-empty names."""
    if value is None:
        return ()
    parts = value.split(",") if isinstance(value, str) else value
    return tuple(part.strip() for part in parts if part.strip())


@dataclass(frozen=True)
class FilterSpec:
    """What to keep: several names in one field are OR-ed, the fields are AND-ed."""

    process: tuple[str, ...] | str | list | None = ()
    pid: int | None = None
    subsystem: tuple[str, ...] | str | list | None = ()
    category: tuple[str, ...] | str | list | None = ()
    level: str | None = None
    grep: str | None = None
    exclude_grep: str | None = None
    info: bool = False
    debug: bool = False
    signpost: bool = False

    def __post_init__(self):
        for name in ("process", "subsystem", "category"):
            object.__setattr__(self, name, _names(getattr(self, name)))
        if self.level is not None:
            object.__setattr__(self, "level", levels_at_least(self.level)[0])

    def emission(self) -> tuple[bool, bool]:
        """Whether (info, debug) rows are produced by a live or historical scan.

        A bare subsystem filter brings both along, as does asking for signposts or for a
        minimum level that low.
        """
        bare_subsystem = bool(self.subsystem) and self.level is None and not (self.info or self.debug)
        debug = self.debug or self.signpost or bare_subsystem or self.level == "Debug"
        info = self.info or debug or self.level == "Info"
        return info, debug

    def fields(self) -> list[Column]:
        """The field predicates, without level and text."""
        found = []
        if self.pid is not None:
            found.append(pid_eq(self.pid))
        if self.subsystem:
            found.append(subsystem_prefix(list(self.subsystem)))
        if self.category:
            found.append(category_eq(list(self.category)))
        if self.process:
            found.append(any_of([process_ci(name) for name in self.process]))
        return found

    def chain(self) -> list[Column]:
        """All predicates in the order they should be tested: cheap ones first."""
        found = [min_level(self.level)] if self.level is not None else []
        found += self.fields()
        if self.grep is not None:
            check_regex(self.grep, "grep")
            found.append(grep(self.grep))
        if self.exclude_grep is not None:
            check_regex(self.exclude_grep, "exclude_grep")
            found.append(exclude_grep(self.exclude_grep))
        return found

    def replaced(self, **changes) -> "FilterSpec":
        return replace(self, **changes)


def check_regex(pattern: str, name: str) -> None:
    """Raise ValueError naming the field if Spark cannot compile the pattern.

    Matching one literal against it is folded by the optimizer; no job runs.
    """
    spark = SparkSession.active()
    try:
        spark.range(0).select(F.lit("").rlike(_flagged(pattern, False)).alias("ok")).where("ok").collect()
    except Exception as error:
        raise ValueError(f"Invalid '{name}' regex: {pattern}") from error


# --- whole-scan filters ------------------------------------------------------------------


def emission_filter(logs: DataFrame, spec: FilterSpec) -> DataFrame:
    """Drop the Debug and Info rows that a live or historical scan would not have produced."""
    info, debug = spec.emission()
    dropped = [name for name, kept in (("Debug", debug), ("Info", info)) if not kept]
    return logs.where(~_when_set("level", F.col("level").isin(dropped))) if dropped else logs


def signpost_visibility(logs: DataFrame, include: bool = False) -> DataFrame:
    """Interval events stay hidden unless asked for."""
    return logs if include else logs.where(~signposts_only())


def scan_filter(logs: DataFrame, spec: FilterSpec, mode: str = "replay") -> DataFrame:
    """All row filters of one query.

    `replay` (rows of an earlier result) applies the predicates only. `live` (live and
    historical scans) first applies what the log store itself does: the case-sensitive path
    test, the emission rules, and hiding interval events.
    """
    if mode not in ("live", "replay"):
        raise ValueError(f"mode must be 'live' or 'replay', got {mode!r}")
    if mode == "live":
        logs = signpost_visibility(emission_filter(logs, spec), include=spec.signpost)
        if spec.signpost:
            logs = logs.where(signposts_only())
        if spec.process:
            logs = logs.where(process_path_suffix(list(spec.process)))
    return logs.where(filter_chain(spec.chain()))


def signpost_filter(logs: DataFrame, spec: FilterSpec, mode: str = "replay") -> DataFrame:
    """Interval events matching the field filters; level and text do not apply to them."""
    if mode == "live" and spec.process:
        logs = logs.where(process_path_suffix(list(spec.process)))
    return logs.where(filter_chain([signposts_only()] + spec.fields()))


def time_range(
    logs: DataFrame,
    last: str | None = None,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    now: dt.datetime | str | None = None,
    boot: dt.datetime | str | None = None,
) -> DataFrame:
    """Rows in the last duration, since boot (`last="boot"`), or from start to end, both inclusive.

    The bounds become literals of the column's own type, so they are pushed to the scan. A
    table laid out by `log_date` is pruned by day as well.
    """
    if last is not None and (start is not None or end is not None):
        raise ValueError("last cannot be combined with start or end")
    if end is not None and start is None:
        raise ValueError("end requires start")
    kind = logs.schema["timestamp"].dataType

    def moment(value) -> Column:
        return F.lit(value).cast(kind)

    if last is not None and last.lower() == "boot":
        if boot is None:
            raise ValueError("last='boot' needs the boot time")
        start = boot
    elif last is not None:
        seconds = duration_seconds(last, "last")
        present = F.current_timestamp().cast(kind) if now is None else moment(now)
        low = present - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
        return _within(logs, low, None)
    if start is None:
        return logs
    return _within(logs, moment(start), None if end is None else moment(end))


def _within(logs: DataFrame, low: Column, high: Column | None) -> DataFrame:
    by_day = "log_date" in logs.columns
    logs = logs.where(F.col("timestamp") >= low)
    if by_day:
        logs = logs.where(F.col("log_date") >= low.cast("date"))
    if high is not None:
        logs = logs.where(F.col("timestamp") <= high)
        if by_day:
            logs = logs.where(F.col("log_date") <= high.cast("date"))
    return logs
