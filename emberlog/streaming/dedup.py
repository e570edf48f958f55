"""Collapsing repeats over live rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.ordered import collapse_runs
from emberlog.streaming.batches import CARRIED, batch_path, last_batch, numbered


def dedup_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write the runs of one batch; its last run stays `open`, and the next batch takes it up.

    Reads only the table of the batch before and replaces that of this one, so doing a batch
    again gives the same table.
    """
    rows = numbered(batch).drop("arrival").withColumns(
        {"repeat_count": F.lit(1).cast("long"), "head_batch": F.lit(batch_id).cast("long"), "_arrival": F.col("seq")}
    )
    if batch_id > 0:
        before = batch.sparkSession.read.parquet(batch_path(path, batch_id - 1)).where("open")
        rows = rows.unionByName(before.drop("open").withColumn("_arrival", F.lit(CARRIED)))
    runs = collapse_runs(rows, order="_arrival").persist()
    try:
        newest = runs.agg(F.max("_arrival")).head()[0]
        still_open = F.lit(False) if newest is None else F.col("_arrival") == newest
        runs.withColumn("open", still_open).drop("_arrival").write.mode("overwrite").parquet(batch_path(path, batch_id))
    finally:
        runs.unpersist()


def stream_dedup(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Collapse consecutive equal messages of a stream into the batch table at `path`."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(lambda batch, batch_id: dedup_batch(batch, batch_id, path)).start()


def dedup_result(spark: SparkSession, path: str, flush: bool = True) -> DataFrame:
    """Runs found so far; `flush` adds the one still open, as at the end of the stream."""
    table = spark.read.parquet(path)
    done = ~F.col("open")
    if flush:
        done = done | (F.col("batch_id") == F.lit(last_batch(table)))
    return table.where(done).drop("open", "batch_id")
