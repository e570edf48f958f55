"""Text forms of a row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import path_basename
from emberlog.functions.times import clock_time

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def _level_tag() -> Column:
    return F.concat(F.lit("["), F.upper("level"), F.lit("]"))


def render_plain(
    show_time: bool = True,
    show_level: bool = True,
    show_process: bool = True,
    show_subsystem: bool = True,
    time: Column | None = None,
) -> Column:
    """`time [LEVEL] process[pid] (subsystem:category) message`; each part can be switched off.

    `time` replaces the clock time, for instance with a relative time column.
    """
    origin = F.concat(
        F.lit("("), F.col("subsystem"), F.coalesce(F.concat(F.lit(":"), F.col("category")), F.lit("")), F.lit(")")
    )
    parts = [
        (show_time, clock_time(F.col("timestamp")) if time is None else time),
        (show_level, _level_tag()),
        (show_process, F.concat(F.col("processName"), F.lit("["), F.col("pid").cast("string"), F.lit("]"))),
        (show_subsystem, origin),
        (True, F.col("message")),
    ]
    return F.concat_ws(" ", *[part for shown, part in parts if shown])


def render_compact(time: Column | None = None) -> Column:
    """`time [LEVEL] message`."""
    return render_plain(show_process=False, show_subsystem=False, time=time)


def render_detail() -> Column:
    """`ISO-time [Level] process (pid) [subsystem] [category] <sender> message`."""

    def boxed(left: str, value: Column, right: str) -> Column:
        return F.concat(F.lit(left), value, F.lit(right))

    return F.concat_ws(
        " ",
        F.date_format("timestamp", ISO_MILLIS),
        boxed("[", F.col("level"), "]"),
        F.col("processName"),
        boxed("(", F.col("pid").cast("string"), ")"),
        boxed("[", F.col("subsystem"), "]"),
        boxed("[", F.col("category"), "]"),
        boxed("<", path_basename(F.col("senderImagePath")), ">"),
        F.col("message"),
    )


def render_kv() -> Column:
    """`key: value` lines; subsystem and category only when present."""

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value)

    return F.concat_ws(
        "\n",
        line("timestamp", F.date_format("timestamp", ISO_MILLIS)),
        line("process", F.col("processName")),
        line("pid", F.col("pid").cast("string")),
        line("level", F.col("level")),
        line("message", F.col("message")),
        line("subsystem", F.col("subsystem")),
        line("category", F.col("category")),
    )


def highlight(col: Column, pattern: str, mark: str = "**") -> Column:
    """Wrap every case-insensitive match of `pattern` in `mark`."""
    quoted = mark.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col, f"(?iu){pattern}", f"{quoted}$0{quoted}")
