"""Stored logs, and results written out to be read again."""

import posixpath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import parse_timestamp, trim_blank
from emberlog.operators.filters import FilterSpec, scan_filter, time_range
from emberlog.schema import LEVELS, LOG_COLUMNS, SIGNPOST_TYPES, SPILL_REQUIRED, SPILL_SCHEMA
from emberlog.sources.decode import once, parse_objects
from emberlog.sources.ingest import in_uint64, ingest_mixed
from emberlog.sources.lines import read_lines

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# The columns of structured output, in order; `process` is the process name.
STRUCTURED = [
    "timestamp", "process", "pid", "level", "message", "subsystem", "category", "threadID", "activityID",
    "processImagePath", "senderImagePath", "traceID", "eventType", "source",
]


def read_logs(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A stored log table (`parquet`), or raw lines (`text`: NDJSON and the older layout)."""
    if format == "parquet":
        return spark.read.parquet(path)
    if format == "text":
        return ingest_mixed(read_lines(spark, path)).logs
    raise ValueError(f"format must be 'parquet' or 'text', got {format!r}")


def scan_historical(
    spark: SparkSession,
    path: str,
    spec: FilterSpec | None = None,
    format: str = "parquet",
    include_source: bool = False,
    **range_,
) -> DataFrame:
    """Stored logs in a time range (see `time_range`) that pass the filters."""
    if range_.get("last") is None and range_.get("start") is None:
        raise ValueError("Specify a time range with last or start")
    logs = time_range(read_logs(spark, path, format), **range_)
    return source_projection(scan_filter(logs, spec or FilterSpec(), mode="live"), include_source)


def scan_archive(
    spark: SparkSession,
    path: str,
    spec: FilterSpec | None = None,
    format: str = "parquet",
    include_source: bool = False,
    **range_,
) -> DataFrame:
    """The same over an archive the caller names; no range is needed."""
    logs = time_range(read_logs(spark, path, format), **range_)
    return source_projection(scan_filter(logs, spec or FilterSpec(), mode="live"), include_source)


def source_projection(logs: DataFrame, include: bool = False) -> DataFrame:
    """Source places only when asked for; otherwise the column is not even read."""
    if include or "source" not in logs.columns:
        return logs
    return logs.withColumn("source", F.lit(None).cast("string"))


def structured_output(logs: DataFrame) -> DataFrame:
    """The columns shown to users; interval fields are left out."""
    return logs.select(*[F.col("processName").alias(name) if name == "process" else name for name in STRUCTURED])


def structured_json(logs: DataFrame) -> DataFrame:
    """`structured_output` as one JSON object per row, absent fields left out, keys sorted."""
    shown = structured_output(logs)
    packed = F.struct(*sorted(shown.columns))
    return shown.select(F.to_json(packed, {"timestampFormat": MICROS, "timestampNTZFormat": MICROS[:-3]}).alias("value"))


def _plain_path(path: str) -> str:
    return posixpath.normpath(unquote(urlparse(path).path or path))


def write_spill(logs: DataFrame, path: str) -> None:
    """Write rows as NDJSON in arrival order, keys sorted, absent fields left out; replaces `path`.

    The order survives in the names of the part files, which a range sort writes in parallel.
    """
    target = _plain_path(path)
    for file in logs.inputFiles():
        if (_plain_path(file) + "/").startswith(target + "/"):
            raise ValueError("the output must differ from the source, which is still being read")
    columns = sorted(name for name in LOG_COLUMNS if name != "seq" and name in logs.columns)
    rows = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).orderBy("seq").select(*columns)
    rows.write.mode("overwrite").option("timestampFormat", MICROS).json(path)


class SpillError(ValueError):
    """A line of a spill that is no log row."""


def replay_spill(spark: SparkSession, path: str, spec: FilterSpec | None = None) -> DataFrame:
    """Rows of an earlier result that pass the filters.

    Blank lines are skipped. Any other line that is not a row raises SpillError with the file
    and line of the first one, before any row is returned.
    """
    lines = once(read_lines(spark, path), _line=trim_blank(F.col("value"))).where("_line <> ''")
    parsed = parse_objects(lines, SPILL_SCHEMA)
    row = F.col("_raw")
    parsed = once(parsed, _time=parse_timestamp(row["timestamp"]))
    valid = F.col("_time").isNotNull() & row["level"].isin(LEVELS) & in_uint64(row["signpostID"])
    for name in SPILL_REQUIRED:
        valid = valid & row[name].isNotNull()
    valid = valid & F.coalesce(row["signpostType"].isin(SIGNPOST_TYPES), F.lit(True))
    valid = F.coalesce(valid, F.lit(False))
    first = parsed.where(~valid).agg(F.min(F.struct("seq", "file", "line_no")).alias("bad")).head()["bad"]
    if first is not None:
        raise SpillError(f"Failed to parse NDJSON at {_plain_path(first['file'])}:{first['line_no']}")
    logs = parsed.select(
        "seq", *[(F.col("_time") if name == "timestamp" else row[name]).alias(name) for name in LOG_COLUMNS[1:]]
    )
    return scan_filter(logs, spec or FilterSpec(), mode="replay")
