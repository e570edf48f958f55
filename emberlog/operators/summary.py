"""Counts, top lists and time bounds.

Everything starts from one pass that counts the combinations of level, process, subsystem and
category; map-side partial aggregation shrinks that to a few rows per task, hot values
included. The lists are read off the combinations, not off the rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_N = 10
DIMENSIONS = ["level", "processName", "subsystem", "category"]


def count_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("count"))


def _top(logs: DataFrame, column: str, n: int) -> DataFrame:
    counts = logs.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("name")).limit(n)


def _named(logs: DataFrame, column: str) -> DataFrame:
    return logs.where(F.col(column) != "")


def top_processes(logs: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n commonest, count descending then name ascending."""
    return _top(logs, "processName", n)


def top_subsystems(logs: DataFrame, n: int = TOP_N) -> DataFrame:
    """Like `top_processes`; rows without a subsystem do not count."""
    return _top(_named(logs, "subsystem"), "subsystem", n)


def top_categories(logs: DataFrame, n: int = TOP_N) -> DataFrame:
    """Like `top_processes`; rows without a category do not count."""
    return _top(_named(logs, "category"), "category", n)


def time_bounds(logs: DataFrame) -> DataFrame:
    """One row: the timestamps of the first and last row to arrive (not the least and greatest)."""
    return logs.agg(F.min_by("timestamp", "seq").alias("start"), F.max_by("timestamp", "seq").alias("end"))


def combination_counts(logs: DataFrame) -> DataFrame:
    """Rows per (level, process, subsystem, category), with the first and last arrival."""
    return logs.groupBy(*DIMENSIONS).agg(
        F.count("*").alias("count"),
        F.min("seq").alias("first_seq"),
        F.min_by("timestamp", "seq").alias("first_time"),
        F.max("seq").alias("last_seq"),
        F.max_by("timestamp", "seq").alias("last_time"),
    )


def _unfolded(combinations: DataFrame, *dimensions: str) -> DataFrame:
    """A row per combination and dimension, for the values that count in that dimension."""
    values = [
        F.struct(F.lit(name).alias("dimension"), (F.col(name) if name in DIMENSIONS else F.lit("")).alias("name"))
        for name in dimensions
    ]
    rest = [name for name in combinations.columns if name not in DIMENSIONS]
    rows = combinations.select(F.inline(F.array(*values)), *rest)
    return rows.where(F.col("name").isNotNull() & ((F.col("name") != "") | ~F.col("dimension").isin("subsystem", "category")))


def dimension_counts(combinations: DataFrame) -> DataFrame:
    """Rows per value of each dimension: (dimension, name, count)."""
    return _unfolded(combinations, *DIMENSIONS).groupBy("dimension", "name").agg(F.sum("count").alias("count"))


def summary_of(combinations: DataFrame, n: int = TOP_N) -> DataFrame:
    """The result summary of rows already counted by combination.

    One chain of aggregations from there on, with the totals as one more dimension: branches
    for counts and bounds would each read the rows again.
    """
    total = F.col("dimension") == "total"
    per_value = _unfolded(combinations, *DIMENSIONS, "total").groupBy("dimension", "name").agg(
        F.sum("count").alias("count"),
        F.min_by("first_time", "first_seq").alias("first_time"),
        F.max_by("last_time", "last_seq").alias("last_time"),
    )
    # Every level is first in a group of its own, so all are told; of the other dimensions each
    # task drops what cannot be among the leaders before the shuffle.
    alone = F.when(F.col("dimension") == "level", F.col("name"))
    order = Window.partitionBy("dimension", alone).orderBy(F.desc("count"), F.asc("name"))
    leaders = per_value.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    def buckets(dimension: str) -> Column:
        found = F.collect_list(F.when(F.col("dimension") == dimension, F.struct("rank", "name", "count")))
        return F.transform(F.array_sort(found), lambda b: F.struct(b["name"].alias("name"), b["count"].alias("count")))

    levels = F.collect_list(F.when(F.col("dimension") == "level", F.struct("name", "count")))
    bounds = F.struct(F.col("first_time").alias("start"), F.col("last_time").alias("end"))
    return leaders.agg(
        F.coalesce(F.max(F.when(total, F.col("count"))), F.lit(0)).alias("count"),
        F.first(F.when(total, bounds), ignorenulls=True).alias("time_range"),
        F.map_from_entries(levels).alias("by_level"),
        buckets("processName").alias("top_processes"),
        buckets("subsystem").alias("top_subsystems"),
        buckets("category").alias("top_categories"),
    )


def result_summary(logs: DataFrame, n: int = TOP_N) -> DataFrame:
    """One row: count, time_range, by_level, top_processes, top_subsystems, top_categories."""
    return summary_of(combination_counts(logs), n)
