"""One-row answers: counts, summary and a bounded sample of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.filters import FilterSpec
from emberlog.operators.limits import empty_hint, limit_n
from emberlog.operators.summary import TOP_N, combination_counts, summary_of
from emberlog.sources.store import write_spill


def retained_rows(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows an answer is about, as a frame to write or read on: all, or the first `limit`."""
    return logs if limit is None else limit_n(logs, limit)


def _nested(rows: DataFrame, up: bool, most: int) -> Column:
    """The first (or last) `most` rows in arrival order, as one array: a top-n sort, no numbering."""
    end = rows.orderBy(F.col("seq").asc() if up else F.col("seq").desc()).limit(most)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("_at"), F.struct(*rows.columns).alias("_row"))))
    return end.agg(F.transform(pairs, lambda e: e["_row"]).alias("_rows")).scalar()


def sampled_summary(
    logs: DataFrame, limit: int | None, threshold: int | None, k: int | None, full: bool, n: int = TOP_N
) -> DataFrame:
    """One row: the summary of all of logs, `truncated`, and `entries` or `head` and `tail`.

    Counts come from one pass with map-side combining. Samples are taken beside it, and only if
    they are asked for: up to `threshold` of the first `limit` rows are entries, else the first
    and last `k` of them are head and tail; `full` nests all of the first `limit`. `truncated`
    tells that rows counted are not shown.
    """
    answer = summary_of(combination_counts(logs), n)
    if full:
        if limit is None:
            raise ValueError("full nests rows in one answer: name a limit, or take retained_rows() as a frame")
        entries = _nested(logs, True, limit)
        answer = answer.withColumn("entries", entries)
        none = F.when(F.lit(False), F.col("entries"))
        answer = answer.withColumns({"head": none, "tail": none})
        shown = F.size("entries")
    elif threshold is None or k is None:
        return answer.withColumn("truncated", F.col("count") > 0)
    else:
        rows = retained_rows(logs, limit)
        size = F.col("count") if limit is None else F.least(F.col("count"), F.lit(limit))
        whole = size <= threshold
        tail = F.least(F.lit(k), F.greatest(size - k, F.lit(0))).cast("int")
        answer = answer.withColumns({"_first": _nested(rows, True, max(threshold, k)), "_last": _nested(rows, False, k)})
        last = F.when(tail > 0, F.slice("_last", -tail, tail)).otherwise(F.slice("_last", 1, 0))
        answer = answer.withColumns(
            {
                "entries": F.when(whole, F.col("_first")),
                "head": F.when(~whole, F.slice("_first", 1, k)),
                "tail": F.when(~whole, last),
            }
        ).drop("_first", "_last")
        shown = F.when(whole, F.size("entries")).otherwise(F.size("head") + F.size("tail"))
    return answer.withColumn("truncated", shown < F.col("count"))


def summary_struct(answer: DataFrame) -> DataFrame:
    """Fold the summary columns into one, null when nothing was found."""
    parts = ["time_range", "by_level", "top_processes", "top_subsystems", "top_categories"]
    return answer.withColumn("summary", F.when(F.col("count") > 0, F.struct(*parts))).drop(*parts)


def written_envelope(
    logs: DataFrame,
    path: str,
    threshold: int,
    k: int,
    limit: int | None = None,
    ceiling: int | None = None,
    spec: FilterSpec | None = None,
    last: str | None = None,
    n: int = TOP_N,
) -> DataFrame:
    """A `result_envelope` whose rows are written out when the answer does not show them all.

    Adds `output_file`: `path`, which then holds all rows, or the first `limit`, as `write_spill`
    leaves them for `replay_spill`; null if the answer shows them, and then nothing is written.
    The answer is computed here, once; a file that stands at `path` already is replaced.
    """
    spark = logs.sparkSession
    seen = logs if ceiling is None else limit_n(logs, ceiling)
    answer = result_envelope(logs, limit, ceiling, threshold, k, spec=spec, last=last, n=n)
    answer = answer.withColumn("output_file", F.when(F.col("entries").isNull(), F.lit(path)))
    told = answer.collect()
    if told[0]["output_file"] is not None:
        write_spill(retained_rows(seen, limit), path)
    return spark.createDataFrame(told, answer.schema)


def result_envelope(
    logs: DataFrame,
    limit: int | None = None,
    ceiling: int | None = None,
    threshold: int | None = None,
    k: int | None = None,
    full: bool = False,
    summary_only: bool = False,
    spec: FilterSpec | None = None,
    last: str | None = None,
    n: int = TOP_N,
) -> DataFrame:
    """One row about rows already filtered: count, scan_capped, truncated, summary,
    entries or head and tail, next_since, hint_code, hint.

    Count and summary cover all rows, or the first `ceiling` if that is named. Rows are shown
    only if `threshold` and `k`, or `full` with a `limit`, ask for them (see `sampled_summary`);
    `retained_rows` has them as a frame. `spec` and `last` are the query's parameters, for the
    hint of an empty answer.
    """
    if full and summary_only:
        raise ValueError("full and summary_only are mutually exclusive")
    seen = logs if ceiling is None else limit_n(logs, ceiling)
    if summary_only:
        answer = summary_of(combination_counts(seen), n).withColumn("truncated", F.col("count") > 0)
    else:
        answer = sampled_summary(seen, limit, threshold, k, full, n)
    answer = answer.withColumns(
        {
            "scan_capped": F.lit(False) if ceiling is None else F.col("count") >= ceiling,
            "next_since": F.col("time_range.end") + F.expr("INTERVAL '0.000001' SECOND"),
        }
    )
    return empty_hint(summary_struct(answer), spec or FilterSpec(), last)
