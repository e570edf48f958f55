"""Timestamps, durations and their text forms.

Text is built from whole microseconds, so it does not depend on how an engine prints doubles.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE

# The accepted timestamp layouts, tried in this order.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSSSSSZ",
]

# A positive decimal number with an optional unit, and seconds per unit.
DURATION = r"^\+?((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)([sSmMhH]?)$"
UNIT_SECONDS = {"": 1, "s": 1, "m": 60, "h": 3600}


def parse_timestamp(col: Column) -> Column:
    """ISO-8601 with or without a fraction, or the log store's layout; null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS])


def parse_duration(col: Column) -> Column:
    """`5s`, `2m`, `1.5h` or bare seconds as seconds; null for empty, non-positive or other text."""
    text = F.regexp_replace(col, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")
    number = F.regexp_extract(text, DURATION, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, DURATION, 2))
    seconds = F.when(unit == "m", number * 60).when(unit == "h", number * 3600).otherwise(number)
    return F.when(seconds > 0, seconds)


def duration_seconds(text: str, option: str = "duration") -> float:
    """Driver-side form of `parse_duration`, raising on text it cannot take."""
    trimmed = text.strip(" \t")
    if not trimmed:
        raise ValueError(f"{option} cannot be empty")
    match = re.match(DURATION, trimmed)
    seconds = float(match[1]) * UNIT_SECONDS[match[2].lower()] if match else 0.0
    if seconds <= 0:
        raise ValueError(f"{option} must be a positive number with optional suffix (s, m, h). Got: {text}")
    return seconds


def duration_us(begin: Column, end: Column) -> Column:
    """Whole microseconds from begin to end; negative when end is earlier."""
    return F.timestamp_diff("MICROSECOND", begin, end)


def ms_from_us(us: Column) -> Column:
    return us.cast("double") / F.lit(1000.0)


def duration_ms(begin: Column, end: Column) -> Column:
    return ms_from_us(duration_us(begin, end))


def round_ms(col: Column) -> Column:
    """Three decimals, ties away from zero."""
    return F.round(col, 3)


def clock_time(col: Column) -> Column:
    return F.date_format(col, "HH:mm:ss.SSS")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _whole(a: Column, b: int) -> Column:
    """Integer quotient of a non-negative BIGINT, without a detour over doubles."""
    return F.call_function("div", a, F.lit(b))


def relative_text(delta_us: Column) -> Column:
    """`+0.312s`, `+2m05.00s`, `+1h02m`; null (no earlier row) shows as `+0.000s`."""
    size = F.abs(delta_us)
    sign = F.when(delta_us < 0, "-").otherwise("+")
    millis = _whole(size + 500, 1000)
    seconds = F.concat(sign, _whole(millis, 1000).cast("string"), F.lit("."), _padded(millis % 1000, 3), F.lit("s"))
    minute = _whole(size, MINUTE)
    hundredths = _whole(size - minute * MINUTE + 5000, 10_000)
    minutes = F.concat(
        sign, minute.cast("string"), F.lit("m"),
        _padded(_whole(hundredths, 100), 2), F.lit("."), _padded(hundredths % 100, 2), F.lit("s"),
    )
    hour = _whole(size, HOUR)
    hours = F.concat(sign, hour.cast("string"), F.lit("h"), _padded(_whole(size, MINUTE) % 60, 2), F.lit("m"))
    return (
        F.when(delta_us.isNull(), "+0.000s")
        .when(size < MINUTE, seconds)
        .when(size < HOUR, minutes)
        .otherwise(hours)
    )


def format_ms(us: Column) -> Column:
    """Microseconds as `128ms` (100 ms and more), `1.1ms` below, `-` for null."""
    size = F.abs(us)
    sign = F.when(us < 0, "-").otherwise("")
    whole = F.concat(_whole(size + 500, 1000).cast("string"), F.lit("ms"))
    tenths = _whole(size + 50, 100)
    short = F.concat(sign, _whole(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("ms"))
    return F.when(us.isNull(), "-").when(us >= 100_000, whole).otherwise(short)
