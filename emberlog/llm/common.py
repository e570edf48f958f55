"""Helpers shared by the operators: tables in the shared folder, words, Python workers."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space and upper case letters of the contracts.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/emberlog/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new folder below the shared root and read it back.

    Cuts lineage: what is downstream survives lost executors without computing df again. The
    folder stays until whoever owns the shared root clears it, as Spark's own checkpoints do.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, or that with as many underscores after it as keep it apart from all columns."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def import_path(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package as the driver does."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def one_space(text: Column) -> Column:
    """Replace every run of ASCII white space by one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
