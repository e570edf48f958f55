"""Queries over column functions, with their SQL twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import functions as fn
from emberlog.catalog.tables import DOCUMENTS_CTE, LOGS_CTE, comparable, document_logs, event_logs, table


def _columns(**build):
    """A query computing columns of the log table, next to `seq`."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = event_logs(spark, sf_dir)
        return comparable(logs.select("seq", *[make().alias(name) for name, make in build.items()]))

    return query


def _sql(**columns: str) -> str:
    listed = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return f"{LOGS_CTE} SELECT seq, {listed} FROM logs"


def _parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in every layout, one of them unreadable, and read back."""
    logs = event_logs(spark, sf_dir).withColumn("_utc", F.col("timestamp").cast("timestamp"))
    texts = (
        F.when(F.col("seq") % 4 == 0, F.date_format("_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        .when(F.col("seq") % 4 == 1, F.date_format("_utc", "yyyy-MM-dd HH:mm:ss.SSSSSSZ"))
        .when(F.col("seq") % 4 == 2, F.date_format("_utc", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise(F.date_format("_utc", "yyyy-MM-dd"))
    )
    return comparable(logs.select("seq", fn.parse_timestamp(texts).alias("parsed")))


def _intervals_column(**build):
    """A query over the whole microseconds between neighbouring lines of an order."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        us = F.round(F.col("l_extendedprice") * 1000).cast("long") - 20_000_000
        rows = lines.select("l_orderkey", "l_linenumber", us.alias("us"))
        return rows.select("l_orderkey", "l_linenumber", *[make(F.col("us")).alias(n) for n, make in build.items()])

    return query


_US = "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 1000) AS BIGINT) - 20000000 AS us FROM lineitem"


def _format_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    place = F.struct(
        F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("symbol"),
        F.when(F.col("user_id") % 3 == 0, F.lit("main.c")).when(F.col("user_id") % 3 == 1, F.lit("")).alias("file"),
        (F.col("user_id") % 4).alias("line"),
        F.when(F.col("user_id") % 5 == 0, F.lit("Core")).alias("image"),
    )
    return events.select("event_id", fn.format_source(place).alias("source"))


def _split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts cut at their commas."""
    tokens = document_logs(spark, sf_dir).select("seq", fn.split_csv(F.col("message")).alias("tokens"))
    return tokens.select("seq", F.size("tokens").alias("n"), F.array_join("tokens", "|").alias("tokens"))


def _highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = document_logs(spark, sf_dir)
    return logs.select("seq", fn.highlight(F.col("message"), "ther|é[a-z]+").alias("marked"))


QUERIES = {
    "parse_timestamp": _parse_timestamp,
    "parse_level": _columns(
        ingested=lambda: fn.parse_level(F.upper(F.expr("CASE WHEN seq % 7 = 0 THEN 'odd' ELSE level END"))),
        typed=lambda: fn.parse_level(F.expr("CASE WHEN seq % 7 = 0 THEN 'odd' ELSE lower(level) END"), unknown=None),
    ),
    "level_rank": _columns(level=lambda: F.col("level"), rank=lambda: fn.level_rank(F.col("level"))),
    "level_code": _columns(level=lambda: F.col("level"), code=lambda: fn.level_code(F.col("level"))),
    "parse_signpost_type": _columns(
        kind=lambda: fn.parse_signpost_type(F.upper(F.coalesce(F.col("signpostType"), F.col("message"))))
    ),
    "path_basename": _columns(
        name=lambda: fn.path_basename(F.expr("processImagePath || CASE WHEN seq % 2 = 0 THEN '//' ELSE '' END")),
        root=lambda: fn.path_basename(F.expr("CASE WHEN seq % 2 = 0 THEN '/' ELSE senderImagePath END")),
    ),
    "format_source": _format_source,
    "split_csv": _split_csv,
    "parse_duration": _columns(
        seconds=lambda: fn.parse_duration(
            F.expr(
                "CASE seq % 6 WHEN 0 THEN ' ' || threadID || 's ' WHEN 1 THEN threadID || 'M' "
                "WHEN 2 THEN threadID || '.5h' WHEN 3 THEN CAST(threadID AS STRING) WHEN 4 THEN '-' || threadID "
                "ELSE message END"
            )
        )
    ),
    "clock_time": _columns(clock=lambda: fn.clock_time(F.col("timestamp"))),
    "format_ms": _intervals_column(text=fn.format_ms),
    "round_ms": _intervals_column(ms=lambda us: fn.round_ms(us / F.lit(7000.0))),
    "relative_text": _intervals_column(text=lambda us: fn.relative_text(us * 100)),
    "duration_ms": _columns(
        ms=lambda: fn.duration_ms(F.expr("CAST('2024-01-15 00:00:00' AS TIMESTAMP_NTZ)"), F.col("timestamp"))
    ),
    "render_plain": _columns(
        text=fn.render_plain,
        short=lambda: fn.render_plain(show_time=False, show_level=False),
        bare=lambda: fn.render_plain(show_process=False, show_subsystem=False),
    ),
    "render_compact": _columns(text=fn.render_compact),
    "render_detail": _columns(text=fn.render_detail),
    "render_kv": _columns(text=fn.render_kv),
    "highlight": _highlight,
}

_CLOCK = "strftime(timestamp, '%H:%M:%S.%g')"
_ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%gZ')"
_ORIGIN = "CASE WHEN subsystem IS NOT NULL THEN '(' || subsystem || coalesce(':' || category, '') || ')' END"
_TAG = "'[' || upper(level) || ']'"
_PROC = "processName || '[' || pid || ']'"

ORACLES = {
    "parse_timestamp": _sql(
        parsed="CASE seq % 4 WHEN 0 THEN timestamp WHEN 1 THEN timestamp "
        "WHEN 2 THEN date_trunc('second', timestamp) - INTERVAL 2 HOUR END"
    ),
    "parse_level": _sql(
        ingested="CASE WHEN seq % 7 = 0 THEN 'Default' ELSE level END", typed="CASE WHEN seq % 7 <> 0 THEN level END"
    ),
    "level_rank": _sql(
        level="level",
        rank="CAST(CASE level WHEN 'Debug' THEN 0 WHEN 'Info' THEN 1 WHEN 'Default' THEN 2 WHEN 'Error' THEN 3 "
        "ELSE 4 END AS INT)",
    ),
    "level_code": _sql(
        level="level",
        code="CAST(CASE level WHEN 'Debug' THEN 0 WHEN 'Info' THEN 1 WHEN 'Default' THEN 2 WHEN 'Error' THEN 16 "
        "ELSE 17 END AS INT)",
    ),
    "parse_signpost_type": _sql(kind="signpostType"),
    "path_basename": _sql(
        name="processName", root="CASE WHEN seq % 2 = 0 THEN '/' WHEN senderImagePath IS NOT NULL THEN 'libtrace.dylib' END"
    ),
    "format_source": """
        SELECT event_id, nullif(concat_ws(' ',
            CASE WHEN user_id % 5 = 0 THEN 'Core' END,
            CASE WHEN user_id % 2 = 0 THEN event_type END,
            CASE WHEN user_id % 3 = 0 THEN 'main.c' || CASE WHEN user_id % 4 > 0 THEN ':' || user_id % 4 ELSE '' END END
        ), '') AS source FROM events""",
    "split_csv": f"""{DOCUMENTS_CTE}, cut AS (
        SELECT seq, list_filter(list_transform(string_split(message, ','), lambda t: trim(t, ' \t ')), lambda t: t <> '')
            AS tokens FROM logs)
        SELECT seq, CAST(len(tokens) AS INT) AS n, array_to_string(tokens, '|') AS tokens FROM cut""",
    "parse_duration": _sql(
        seconds="CASE WHEN threadID > 0 OR seq % 6 = 2 THEN CASE seq % 6 WHEN 0 THEN CAST(threadID AS DOUBLE) "
        "WHEN 1 THEN threadID * 60.0::DOUBLE WHEN 2 THEN (threadID + 0.5::DOUBLE) * 3600 "
        "WHEN 3 THEN CAST(threadID AS DOUBLE) END END"
    ),
    "clock_time": _sql(clock=_CLOCK),
    "format_ms": f"""SELECT l_orderkey, l_linenumber, CASE
        WHEN us >= 100000 THEN (us + 500) // 1000 || 'ms'
        ELSE CASE WHEN us < 0 THEN '-' ELSE '' END || ((abs(us) + 50) // 100) // 10 || '.' || ((abs(us) + 50) // 100) % 10 || 'ms'
        END AS text FROM ({_US})""",
    "round_ms": f"SELECT l_orderkey, l_linenumber, round(us / 7000.0::DOUBLE, 3) AS ms FROM ({_US})",
    "relative_text": f"""SELECT l_orderkey, l_linenumber, CASE WHEN d < 0 THEN '-' ELSE '+' END || CASE
        WHEN a < 60000000 THEN (a + 500) // 1000000 || '.' || lpad(CAST(((a + 500) // 1000) % 1000 AS VARCHAR), 3, '0') || 's'
        WHEN a < 3600000000 THEN m || 'm' || lpad(CAST(h // 100 AS VARCHAR), 2, '0') || '.'
            || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || 's'
        ELSE a // 3600000000 || 'h' || lpad(CAST((a // 60000000) % 60 AS VARCHAR), 2, '0') || 'm' END AS text
        FROM (SELECT *, abs(d) AS a, abs(d) // 60000000 AS m, (abs(d) % 60000000 + 5000) // 10000 AS h
              FROM (SELECT *, us * 100 AS d FROM ({_US})))""",
    "duration_ms": _sql(ms="date_diff('microsecond', TIMESTAMP '2024-01-15 00:00:00', timestamp) / 1000.0::DOUBLE"),
    "render_plain": _sql(
        text=f"concat_ws(' ', {_CLOCK}, {_TAG}, {_PROC}, {_ORIGIN}, message)",
        short=f"concat_ws(' ', {_PROC}, {_ORIGIN}, message)",
        bare=f"concat_ws(' ', {_CLOCK}, {_TAG}, message)",
    ),
    "render_compact": _sql(text=f"concat_ws(' ', {_CLOCK}, {_TAG}, message)"),
    "render_detail": _sql(
        text=f"concat_ws(' ', {_ISO}, '[' || level || ']', processName, '(' || pid || ')', '[' || subsystem || ']', "
        "'[' || category || ']', CASE WHEN senderImagePath IS NOT NULL THEN '<libtrace.dylib>' END, message)"
    ),
    "render_kv": _sql(
        text=f"concat_ws(chr(10), 'timestamp: ' || {_ISO}, 'process: ' || processName, 'pid: ' || pid, 'level: ' || level, "
        "'message: ' || message, 'subsystem: ' || subsystem, 'category: ' || category)"
    ),
    "highlight": (
        f"{DOCUMENTS_CTE} SELECT seq, regexp_replace(message, '(ther|é[a-z]+)', '**\\1**', 'gi') AS marked FROM logs"
    ),
}
