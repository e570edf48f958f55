"""Column functions: every one maps columns to a column and stays inside codegen."""

from emberlog.functions.levels import level_code, level_rank, levels_at_least, parse_level, parse_signpost_type
from emberlog.functions.render import (
    highlight,
    render_compact,
    render_detail,
    render_kv,
    render_plain,
)
from emberlog.functions.text import format_source, path_basename, split_csv, trim_blank
from emberlog.functions.times import (
    clock_time,
    duration_ms,
    duration_seconds,
    duration_us,
    format_ms,
    ms_from_us,
    parse_duration,
    parse_timestamp,
    relative_text,
    round_ms,
)

__all__ = [
    "clock_time",
    "duration_ms",
    "duration_seconds",
    "duration_us",
    "format_ms",
    "format_source",
    "highlight",
    "level_code",
    "level_rank",
    "levels_at_least",
    "ms_from_us",
    "parse_duration",
    "parse_level",
    "parse_signpost_type",
    "parse_timestamp",
    "path_basename",
    "relative_text",
    "render_compact",
    "render_detail",
    "render_kv",
    "render_plain",
    "round_ms",
    "split_csv",
    "trim_blank",
]
