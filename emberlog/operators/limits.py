"""First and last rows, ceilings, cursors and bounded samples."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.ordered import rank_rows


def _positive(n: int, name: str) -> int:
    if n <= 0:
        raise ValueError(f"{name} must be a positive integer")
    return n


def limit_n(logs: DataFrame, n: int) -> DataFrame:
    """The first n rows in arrival order."""
    return rank_rows(logs, F.col("seq"), limit=_positive(n, "limit")).drop("rank")


def last_n(logs: DataFrame, n: int) -> DataFrame:
    """The last n rows in arrival order."""
    return rank_rows(logs, -F.col("seq"), limit=_positive(n, "limit")).drop("rank")


def scan_ceiling(logs: DataFrame, ceiling: int) -> DataFrame:
    """The first `ceiling` rows, numbered, and whether the ceiling was reached.

    Reaching it counts even if the input ends right there.
    """
    seen = rank_rows(logs, F.col("seq"), limit=_positive(ceiling, "ceiling"), total="_all")
    return seen.withColumn("scan_capped", F.col("_all") >= ceiling).drop("_all")


def head_tail(logs: DataFrame, threshold: int, k: int, full: bool = False) -> DataFrame:
    """Sample of a result: all rows up to `threshold` (or with `full`), else the first and last k.

    Adds `position` (`inline`, `head` or `tail`) and `truncated`.
    """
    if full:
        return logs.withColumns({"position": F.lit("inline"), "truncated": F.lit(False)})
    ends = rank_rows(logs, F.col("seq"), limit=max(threshold, k), tail=k, total="_all")
    return _sampled(ends, threshold, k)


def list_head_tail(df: DataFrame, order: list[str], threshold: int, k: int, full: bool = False) -> DataFrame:
    """`head_tail` for any table; `order` names columns (ascending) that identify a row.

    For lists such as the process inventory. Both ends come from top-k sorts, and only they
    are numbered.
    """
    if full:
        return df.withColumns({"position": F.lit("inline"), "truncated": F.lit(False)})
    most = max(threshold, k)
    up, down = [F.col(name).asc() for name in order], [F.col(name).desc() for name in order]
    everything = df.agg(F.count("*")).scalar()
    first = df.orderBy(*up).limit(most).withColumn("_all", everything)
    first = first.withColumn("rank", F.row_number().over(Window.orderBy(*up)))
    last = df.orderBy(*down).limit(k).withColumn("_all", everything)
    last = last.withColumn("rank", F.col("_all") + 1 - F.row_number().over(Window.orderBy(*down)))
    return _sampled(first.union(last.where(F.col("rank") > most)), threshold, k)


def _sampled(ends: DataFrame, threshold: int, k: int) -> DataFrame:
    """Settle the position of rows from both ends by their rank and the number of all rows."""
    truncated = F.col("_all") > threshold
    position = (
        F.when(~truncated, "inline")
        .when(F.col("rank") <= k, "head")
        .when(F.col("rank") > F.col("_all") - k, "tail")
    )
    marked = ends.withColumns({"position": position, "truncated": truncated})
    return marked.where("position is not null").drop("rank", "_all")


def next_since(logs: DataFrame) -> DataFrame:
    """One row: the moment just after the last row seen, null without rows."""
    last = F.max_by("timestamp", "seq")
    return logs.agg((last + F.expr("INTERVAL '0.000001' SECOND")).alias("next_since"))


def tail_cursor(logs: DataFrame, since=None) -> DataFrame:
    """Rows from `since` on, where `since` is an earlier answer's `next_since` (null: all)."""
    if since is None:
        return logs
    return logs.where(F.col("timestamp") >= F.lit(since).cast(logs.schema["timestamp"].dataType))


# Reasons for an empty answer, and what to do about each.
HINTS = {
    "not_persisted": "Nothing is stored for this subsystem at the usual levels; try a live capture.",
    "process_only": "A process alone selects stored rows of the upper levels; add its subsystem.",
    "short_range": "The time range is short; a longer one may hold rows.",
}


def empty_hint(counted: DataFrame, spec, last: str | None = None, count: str = "count") -> DataFrame:
    """Add `hint_code` and `hint` to a counted result: the likeliest reason when the count is 0."""
    if spec.subsystem and spec.level is None:
        code = "not_persisted"
    elif spec.process and not spec.subsystem:
        code = "process_only"
    elif last is not None and (last.endswith("s") or last == "1m"):
        code = "short_range"
    else:
        code = None
    nothing = F.col(count) == 0
    return counted.withColumns(
        {
            "hint_code": F.when(nothing, F.lit(code).cast("string")),
            "hint": F.when(nothing, F.lit(HINTS.get(code)).cast("string")),
        }
    )
