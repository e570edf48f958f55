"""Raw lines to log rows.

Input is (seq, value); further columns are ignored. Each reader returns two frames over one
parse: the rows, and the lines that could not be read. Blank lines are neither.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import (
    format_source,
    parse_level,
    parse_signpost_type,
    parse_timestamp,
    path_basename,
    trim_blank,
)
from emberlog.schema import LOG_SCHEMA, RAW_SCHEMA, UINT64, UINT64_MAX, UNKNOWN_PROCESS
from emberlog.sources.decode import once, parse_objects

# A line of the older layout, `time process[pid] (subsystem) [Level] message`,
# where all between time and message may be missing.
BLANK = r"[\p{Zs}\t]*"
LEGACY_LINE = (
    r"(?s)^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d+[+-]\d{4})" + BLANK
    + r"(?:(\S+)\[(\d+)\]" + BLANK
    + r"(?:\(([^)]+)\)" + BLANK + r")?"
    + r"(?:\[([\p{L}\p{M}\p{N}_]+)\]" + BLANK + r")?)?(.*)$"
)
SEPARATOR = "\x01"


class Ingested(NamedTuple):
    logs: DataFrame
    bad: DataFrame


def _row(values: dict[str, Column]) -> Column:
    """A struct of all canonical columns but seq; those not given are null."""
    return F.struct(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOG_SCHEMA.fields
            if f.name != "seq"
        ]
    )


def in_uint64(value: Column) -> Column:
    return F.coalesce(value.between(F.lit(0).cast(UINT64), F.lit(UINT64_MAX).cast(UINT64)), F.lit(True))


def _json_row() -> Column:
    """The row of a parsed object; null unless its time can be read.

    A time that cannot be read spoils the row. It is never replaced by the present.
    """
    raw = F.col("_raw")
    row = _row(
        {
            "timestamp": F.col("_time"),
            "processName": F.coalesce(path_basename(raw["processImagePath"]), F.lit(UNKNOWN_PROCESS)),
            "pid": F.coalesce(raw["processID"], F.lit(0)),
            "subsystem": raw["subsystem"],
            "category": raw["category"],
            "level": parse_level(raw["messageType"]),
            "message": F.coalesce(raw["eventMessage"], F.lit("")),
            "threadID": raw["threadID"],
            "activityID": raw["activityIdentifier"],
            "traceID": raw["traceID"],
            "processImagePath": raw["processImagePath"],
            "senderImagePath": raw["senderImagePath"],
            "eventType": raw["eventType"],
            "source": format_source(raw["source"]),
            "signpostID": raw["signpostID"],
            "signpostName": raw["signpostName"],
            "signpostType": parse_signpost_type(raw["signpostType"]),
            "signpostScope": raw["signpostScope"],
        }
    )
    return F.when(F.col("_time").isNotNull() & in_uint64(raw["signpostID"]), row)


def _legacy_parts(line: Column) -> Column:
    """The seven parts of a text line from one match; a single part if it does not match."""
    marked = F.regexp_replace(line, LEGACY_LINE, SEPARATOR.join(f"${i}" for i in range(1, 8)))
    return F.split(marked, SEPARATOR, 7)


def _legacy_row() -> Column:
    """The row of a split text line; null unless its time can be read."""

    def part(n: int) -> Column:
        return F.nullif(F.get("_parts", F.lit(n - 1)), F.lit(""))

    # A number that is no pid makes what looks like a process part of the message.
    no_pid = part(4).isNotNull() & part(4).try_cast("long").isNull()
    after_time = F.regexp_extract("_line", r"(?s)^\S+\s+\S+" + BLANK + "(.*)$", 1)
    row = _row(
        {
            "timestamp": F.col("_text_time"),
            "processName": F.coalesce(F.when(no_pid, None).otherwise(part(3)), F.lit(UNKNOWN_PROCESS)),
            "pid": F.coalesce(part(4).try_cast("long"), F.lit(0)),
            "subsystem": F.when(no_pid, None).otherwise(part(5)),
            "level": parse_level(F.when(no_pid, None).otherwise(part(6))),
            "message": F.when(no_pid, after_time).otherwise(F.get("_parts", F.lit(6))),
        }
    )
    return F.when(F.col("_text_time").isNotNull(), row)


def _lines(lines: DataFrame) -> DataFrame:
    return once(lines.select("seq", "value"), _line=trim_blank(F.col("value"))).where("_line <> ''")


def _decode_json(lines: DataFrame) -> DataFrame:
    parsed = parse_objects(lines, RAW_SCHEMA)
    return once(once(parsed, _time=parse_timestamp(F.col("_raw")["timestamp"])), _json=_json_row())


def _decode_legacy(lines: DataFrame, wanted: Column | None = None) -> DataFrame:
    parts = _legacy_parts(F.col("_line"))
    rows = once(lines, _parts=parts if wanted is None else F.when(wanted, parts))
    time = F.concat_ws(" ", F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1)))
    rows = once(rows, _text_time=F.when(F.size("_parts") == 7, parse_timestamp(time)))
    return once(rows, _text=_legacy_row())


def _split(decoded: DataFrame, row: Column) -> Ingested:
    rows = decoded.select("seq", "value", row.alias("row"))
    good = rows.where("row is not null").select("seq", "row.*")
    return Ingested(good, rows.where("row is null").select("seq", "value"))


def ingest_ndjson(lines: DataFrame) -> Ingested:
    return _split(_decode_json(_lines(lines)), F.col("_json"))


def ingest_legacy_text(lines: DataFrame) -> Ingested:
    return _split(_decode_legacy(_lines(lines)), F.col("_text"))


def _decode_mixed(lines: DataFrame) -> DataFrame:
    return _decode_legacy(_decode_json(_lines(lines)), wanted=F.col("_json").isNull())


def ingest_mixed(lines: DataFrame) -> Ingested:
    """JSON lines, and the older text layout for those that are not."""
    return _split(_decode_mixed(lines), F.coalesce("_json", "_text"))


def read_mixed(lines: DataFrame) -> DataFrame:
    """The same as one frame, for writers of both: seq, value, and `row`, null for a line that is none."""
    return _decode_mixed(lines).select("seq", "value", F.coalesce("_json", "_text").alias("row"))
