"""Tables written batch by batch, so that a batch run again replaces what it wrote."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.lines import place_in_files

# Before any arrival number of a batch.
CARRIED = -(1 << 62)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in a place that all executors share.

    That is `spark.checkpoint.dir`, or the warehouse where it is unset. The folder stays until
    whoever owns that place clears it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def batch_path(path: str, batch_id: int) -> str:
    return posixpath.join(path, f"batch_id={batch_id}")


def numbered(batch: DataFrame, first: int = 0) -> DataFrame:
    """Rows of one batch with their arrival number `seq`.

    Rows of a table have their own. Rows of text have `arrival`, the place of their block (see
    `stream_lines`), and are numbered along it, line by line, from `first`; that order does not
    depend on how a batch is cut into tasks, so a batch done again numbers its rows alike.
    """
    if "seq" in batch.columns:
        return batch
    if "arrival" in batch.columns:
        lines = batch.withColumn("_line", F.monotonically_increasing_id())
        placed = place_in_files(lines, "arrival.time", "arrival.file", "arrival.block", "_line")
        return placed.select((F.col("_place") + first).alias("seq"), *batch.columns)
    return batch.select((F.monotonically_increasing_id() + first).alias("seq"), "*")


def last_batch(table: DataFrame) -> int | None:
    return table.agg(F.max("batch_id")).head()[0]
