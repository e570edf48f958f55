"""Text files as numbered lines."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A split table this small is sent to every task; a bigger one is joined by key.
BROADCAST_SPLITS = 200_000


def read_lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Lines of a file or folder as (seq, file, line_no, value).

    `seq` counts from 0 through the files in name order, whatever way Spark splits them: a
    first pass counts the lines of each split (it reads the text but parses nothing), a sum
    over the splits gives each its offset. With `numbered=False` that pass is saved; `seq` is
    then unique and rises within each file, but files come in no set order.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    if not numbered:
        return text.select(F.col("_id").alias("seq"), "file", F.lit(None).cast("long").alias("line_no"), "value")
    # One row per split. Windows over it see as many rows as Spark schedules splits.
    splits = text.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    to_here = (Window.unboundedPreceding, Window.currentRow)
    overall = Window.orderBy("file", "_block").rowsBetween(*to_here)
    in_file = Window.partitionBy("file").orderBy("_block").rowsBetween(*to_here)
    splits = splits.select(
        "file",
        "_block",
        "_first",
        (F.sum("_lines").over(overall) - F.col("_lines")).alias("_offset"),
        (F.sum("_lines").over(in_file) - F.col("_lines")).alias("_file_offset"),
    )
    # Only a file's last split is shorter than a task's fill, so this bounds their number.
    if len(text.inputFiles()) + text.rdd.getNumPartitions() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    nth = F.col("_id") - F.col("_first")
    return text.join(splits, ["file", "_block"]).select(
        (F.col("_offset") + nth).alias("seq"), "file", (F.col("_file_offset") + nth + 1).alias("line_no"), "value"
    )


def place_in_files(lines: DataFrame, time: str, file: str, block: str, row: str) -> DataFrame:
    """Add `_place`, a BIGINT that rises along (time, file, block, row), from 0.

    `row` rises within each split (a block of a file). One row per split goes through a window;
    the lines themselves are only joined to their split's place. Lines may be missing in between.
    """
    order = {"_time": time, "_file": file, "_block": block}
    rows = lines.withColumns({**{name: F.col(source) for name, source in order.items()}, "_row": F.col(row)})
    splits = rows.groupBy(*order).agg(F.min("_row").alias("_first"), (F.max("_row") - F.min("_row") + 1).alias("_span"))
    before = F.sum("_span").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    splits = splits.withColumn("_offset", before - F.col("_span")).drop("_span")
    placed = rows.join(splits, list(order)).withColumn("_place", F.col("_offset") + F.col("_row") - F.col("_first"))
    return placed.select(*lines.columns, "_place")
