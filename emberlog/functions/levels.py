"""Severity levels and interval event types."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schema import LEVEL_CODES, LEVELS, SIGNPOST_TYPES


def _choose(key: Column, table: dict) -> Column:
    """CASE over a small fixed table; null where nothing matches."""
    (first, value), *rest = table.items()
    case = F.when(key == first, F.lit(value))
    for name, result in rest:
        case = case.when(key == name, F.lit(result))
    return case


def parse_level(col: Column, unknown: str | None = "Default") -> Column:
    """Level name in any case; `unknown` stands for absent and unrecognised text.

    Ingest wants "Default" there, user input wants null (`unknown=None`).
    """
    level = _choose(F.lower(col), {name.lower(): name for name in LEVELS})
    return level if unknown is None else F.coalesce(level, F.lit(unknown))


def level_rank(col: Column) -> Column:
    """0 for Debug up to 4 for Fault."""
    return _choose(col, {name: rank for rank, name in enumerate(LEVELS)})


def level_code(col: Column) -> Column:
    """The log store's own numeric code; it orders the levels the same way."""
    return _choose(col, LEVEL_CODES)


def levels_at_least(level: str) -> list[str]:
    """The level names at or above `level`, for a pushable IN list."""
    names = [name.lower() for name in LEVELS]
    if level.lower() not in names:
        raise ValueError(f"Unknown level {level!r}; use one of {', '.join(names)}")
    return LEVELS[names.index(level.lower()):]


def parse_signpost_type(col: Column) -> Column:
    """begin / end / event in any case, null otherwise."""
    return _choose(F.lower(col), {name: name for name in SIGNPOST_TYPES})
