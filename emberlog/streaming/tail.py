"""Live rows, filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberlog.operators.filters import FilterSpec, scan_filter
from emberlog.sources.ingest import ingest_mixed, read_mixed
from emberlog.streaming import versions
from emberlog.streaming.batches import batch_path, numbered

# Where the lines of a batch lie: those that are rows, and those that are none.
ROWS, BAD = "rows", "bad"


def _arrival() -> Column:
    """The place of a line's block: its file's time and path, and where the block begins in the file.

    A file comes in one batch, so this order holds across batches, and it is the same when a batch
    is done again, however its files are dealt to tasks then. Lines of a block come in their order;
    `numbered` counts them where a batch is written.
    """
    return F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def raw_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of files as they appear: (seq, value), where `seq` is the place of the line's block."""
    return spark.readStream.options(**options).text(path).select(_arrival().alias("seq"), "value")


def stream_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of raw line files as they appear, each with the `arrival` of its block; see `bad_lines` for the others."""
    return ingest_mixed(raw_lines(spark, path, **options)).logs.withColumnRenamed("seq", "arrival")


def bad_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines that are no row, as they appear: (arrival, value)."""
    return ingest_mixed(raw_lines(spark, path, **options)).bad.withColumnRenamed("seq", "arrival")


def stream_table(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """Rows of a Parquet folder as files appear."""
    return spark.readStream.options(**options).schema(schema).parquet(path)


def stream_tail(rows: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """The rows a live scan shows. Stateless, so it runs in append mode into any sink."""
    return scan_filter(rows, spec or FilterSpec(), mode="live")


def lines_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Read the lines of one batch and write rows and bad lines, numbered on from the batches before.

    Blank lines are neither, but they count. A batch that a version covers is not done again; the
    version says which number comes next.
    """
    spark = batch.sparkSession
    last = versions.latest(spark, path)
    if last is not None and batch_id <= last.batch_id:
        return
    first = last.note["next"] if last is not None else 0
    lines = numbered(batch.withColumnRenamed("seq", "arrival"), first)
    told = read_mixed(lines).withColumn("part", F.when(F.col("row").isNull(), BAD).otherwise(ROWS))
    told = told.withColumn("value", F.when(F.col("part") == BAD, F.col("value")))
    told.write.mode("overwrite").partitionBy("part").parquet(batch_path(path, batch_id))
    newest = lines.agg(F.max("seq")).head()[0]
    note = {"schema": told.drop("part").schema.jsonValue(), "next": first if newest is None else newest + 1}
    versions.publish(spark, path, batch_id, note)


def write_lines(spark: SparkSession, source: str, path: str, checkpoint: str, options: dict | None = None, **trigger) -> StreamingQuery:
    """Follow a folder of raw lines into the batch table at `path`: rows and bad lines, in arrival order."""
    writer = raw_lines(spark, source, **(options or {})).writeStream.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(lambda batch, batch_id: lines_batch(batch, batch_id, path)).start()


def _lines_table(spark: SparkSession, path: str, part: str) -> DataFrame:
    version = versions.required(spark, path)
    schema = StructType.fromJson(version.note["schema"]).add("batch_id", "long").add("part", "string")
    table = spark.read.schema(schema).parquet(path)
    return table.where((F.col("batch_id") <= version.batch_id) & (F.col("part") == part))


def tailed_rows(spark: SparkSession, path: str, spec: FilterSpec | None = None) -> DataFrame:
    """Rows of all whole batches, with `seq` in arrival order, filtered as a live scan."""
    return stream_tail(_lines_table(spark, path, ROWS).select("seq", "row.*"), spec)


def tailed_bad(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all whole batches that are no row: (seq, value)."""
    return _lines_table(spark, path, BAD).select("seq", "value")
