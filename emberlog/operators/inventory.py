"""Distinct things in arrival order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_first(logs: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The first row of every key value.

    Spark cuts each task's rows to one per key before the shuffle, so a hot key stays small.
    """
    window = Window.partitionBy(key).orderBy(order)
    return logs.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def process_inventory(logs: DataFrame, filter: str | None = None) -> DataFrame:
    """Process names with the pid first seen, optionally only those containing a text in any case."""
    if filter is not None:
        logs = logs.where(F.lower("processName").contains(F.lower(F.lit(filter))))
    found = logs.groupBy(F.col("processName").alias("name")).agg(F.min_by("pid", "seq").alias("pid"))
    return found.orderBy(F.lower("name"), "name")
