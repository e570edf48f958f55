"""Running counts over live rows."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberlog.operators.summary import DIMENSIONS, combination_counts
from emberlog.streaming import versions
from emberlog.streaming.batches import batch_path, numbered

# Batches after which their counts are merged into a snapshot.
MERGED_AFTER = 8


def stream_summary(rows: DataFrame) -> DataFrame:
    """Counts per (level, process, subsystem, category) of a stream, for complete or update mode.

    Any snapshot of them is what `summary_of` and `dimension_counts` start from.
    """
    if "seq" in rows.columns:
        return combination_counts(rows)
    return rows.groupBy(*DIMENSIONS).agg(F.count("*").alias("count"))


def merged_counts(parts: DataFrame) -> DataFrame:
    """Counts of several batches as the counts of them all."""
    return parts.groupBy(*DIMENSIONS).agg(
        F.sum("count").alias("count"),
        F.min("first_seq").alias("first_seq"),
        F.min_by("first_time", "first_seq").alias("first_time"),
        F.max("last_seq").alias("last_seq"),
        F.max_by("last_time", "last_seq").alias("last_time"),
    )


def _parts(spark: SparkSession, path: str, note: dict, upto: int) -> DataFrame:
    """The snapshot and the counts of the batches after it, up to one."""
    schema = StructType.fromJson(note["schema"]).add("batch_id", "long")
    snapshot = note["snapshot"]
    after = F.lit(True) if snapshot is None else F.col("batch_id") > snapshot
    parts = spark.read.schema(schema).parquet(posixpath.join(path, "counts")).where(after & (F.col("batch_id") <= upto))
    if snapshot is not None:
        merged = spark.read.schema(schema).parquet(posixpath.join(path, "snapshots"))
        parts = parts.unionByName(merged.where(F.col("batch_id") == snapshot))
    return parts.drop("batch_id")


def summary_batch(batch: DataFrame, batch_id: int, path: str, merged_after: int = MERGED_AFTER) -> None:
    """Write the counts of one batch; every so often, all counts as a snapshot.

    Nothing is overwritten that a version speaks of: counts of a batch and snapshots lie in
    folders of their own, the version that names them is written last, and what only versions
    before the last one need is removed after it. A batch done again starts from the version
    before.
    """
    spark = batch.sparkSession
    last = versions.latest(spark, path)
    if last is not None and batch_id <= last.batch_id:
        return
    before = last.note if last is not None else {"snapshot": None, "rows": 0, "since": 0}
    counts = combination_counts(numbered(batch, before["rows"]))
    counts.write.mode("overwrite").parquet(batch_path(posixpath.join(path, "counts"), batch_id))
    note = before | {"schema": counts.schema.jsonValue(), "since": before["since"] + 1, "earlier": before["snapshot"]}
    if "seq" not in batch.columns:
        own = spark.read.schema(counts.schema).parquet(batch_path(posixpath.join(path, "counts"), batch_id))
        note["rows"] = max(before["rows"], (own.agg(F.max("last_seq")).head()[0] or -1) + 1)
    if note["since"] >= merged_after:
        merged = merged_counts(_parts(spark, path, note, batch_id))
        merged.write.mode("overwrite").parquet(batch_path(posixpath.join(path, "snapshots"), batch_id))
        note |= {"snapshot": batch_id, "since": 0}
    versions.publish(spark, path, batch_id, note)
    if before.get("earlier") != before["snapshot"] and before["snapshot"] is not None:
        # The version before was the first with its snapshot: what that one merged can go.
        _remove_merged(spark, path, before)


def _remove_merged(spark: SparkSession, path: str, note: dict) -> None:
    schema = StructType.fromJson(note["schema"]).add("batch_id", "long")
    table = spark.read.schema(schema).parquet(posixpath.join(path, "counts"))
    for row in table.where(F.col("batch_id") <= note["snapshot"]).select("batch_id").distinct().collect():
        versions.remove(spark, batch_path(posixpath.join(path, "counts"), row["batch_id"]))
    if note.get("earlier") is not None:
        versions.remove(spark, batch_path(posixpath.join(path, "snapshots"), note["earlier"]))


def write_summary(
    rows: DataFrame, path: str, checkpoint: str, merged_after: int = MERGED_AFTER, **trigger
) -> StreamingQuery:
    """Keep running counts in the table at `path`, to be read by `read_summary`."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(lambda batch, batch_id: summary_batch(batch, batch_id, path, merged_after)).start()


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all whole batches, as `combination_counts` gives them for the whole input."""
    version = versions.required(spark, path)
    return merged_counts(_parts(spark, path, version.note, version.batch_id))
