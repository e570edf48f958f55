"""Queries that write, read back or stream the log table, with their SQL twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalog.tables import LOGS_CTE, as_logs, comparable, event_logs, table
from emberlog.operators.filters import FilterSpec, scan_filter
from emberlog.operators.ordered import task_count
from emberlog.operators.signposts import intervals_of, signpost_summary
from emberlog.operators.summary import dimension_counts, summary_of
from emberlog.plans.envelope import written_envelope
from emberlog.sources.ingest import ingest_legacy_text, ingest_mixed, ingest_ndjson
from emberlog.sources.store import (
    replay_spill,
    scan_archive,
    scan_historical,
    source_projection,
    structured_json,
    structured_output,
    write_spill,
)
from emberlog.streaming.batches import shared_dir
from emberlog.streaming.capture import capture_stream
from emberlog.streaming.dedup import dedup_result, stream_dedup
from emberlog.streaming.signposts import capture_signposts, signposts_result, stream_signposts
from emberlog.streaming.summary import read_summary, write_summary
from emberlog.streaming.tail import stream_table, stream_tail, tailed_bad, tailed_rows, write_lines

# What may follow an object so that its line is none: text, and ways to close the list it is read in.
CLOSED = (" tail", "]} tail", "]}", '],"x":[1')
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _raw_json(logs: DataFrame) -> DataFrame:
    """Log rows as the NDJSON lines they came from; one in six users writes lines that are spoiled."""
    place = F.struct(F.lit("main.c").alias("file"), F.col("threadID").alias("line"), F.lit("Core").alias("image"))
    line = F.to_json(
        F.struct(
            F.date_format(F.col("timestamp").cast("timestamp"), MICROS).alias("timestamp"),
            F.col("processImagePath"),
            F.col("pid").alias("processID"),
            "subsystem",
            "category",
            F.lower("level").alias("messageType"),
            "eventType",
            F.concat_ws(" ", F.lit('say "hi",'), "message").alias("eventMessage"),
            "threadID",
            F.when(F.col("threadID") % 6 == 0, place).alias("source"),
            "signpostID",
            "signpostName",
            F.initcap("signpostType").alias("signpostType"),
            F.lit("ignored").alias("unknownKey"),
        )
    )
    kind = F.col("threadID") % 36
    spoiled = (
        F.when(kind == 1, F.expr("substring(line, 1, length(line) - 3)"))
        .when(kind == 7, F.regexp_replace("line", '"processID":[0-9]+', '"processID":"12"'))
        .when(kind == 13, F.regexp_replace("line", '"eventType":"[a-zA-Z]+"', '"eventType":5'))
        .when(kind == 19, F.regexp_replace("line", '"timestamp":"[^"]*",', ""))
        .when(kind == 25, F.lit("  \t "))
        .when(kind == 31, F.concat("line", F.element_at(F.array(*map(F.lit, CLOSED)), F.col("seq").cast("int") % 4 + 1)))
        .otherwise(F.concat(F.lit("  "), "line"))
    )
    return logs.withColumn("line", line).select("seq", spoiled.alias("value"))


def _raw_text(logs: DataFrame) -> DataFrame:
    """Log rows as lines of the older text layout, in all the forms it comes in."""
    time = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd  HH:mm:ss.SSSSSSZ")
    kind = F.col("threadID") % 7
    rest = (
        F.when(kind == 0, F.concat(F.lit("no process here: "), "message"))
        .when(kind == 1, F.expr("processName || '[' || pid || ']  ' || message"))
        .when(kind == 2, F.expr("processName || '[' || pid || ']  [' || upper(level) || ']  ' || message"))
        .when(kind == 3, F.expr("processName || '[' || pid || '] (com.example.app)  ' || message"))
        .otherwise(F.expr("processName || '[' || pid || ']  (' || coalesce(subsystem, 'none') || ') [' || level || ']  ' || message"))
    )
    line = F.when(kind == 6, rest).otherwise(F.concat(time, F.lit("  "), rest))
    return logs.select("seq", line.alias("value"))


def _mixed_lines(logs: DataFrame) -> DataFrame:
    odd = F.col("seq") % 2 == 1
    return _raw_json(logs.where(~odd)).unionByName(_raw_text(logs.where(odd)))


def _ingested(reader, lines):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs, bad = reader(lines(event_logs(spark, sf_dir)))
        rows = logs.select(
            "seq", "timestamp", "processName", "pid", "subsystem", "category", "level", "message", "threadID",
            "eventType", "source", "signpostID", "signpostName", "signpostType",
        ).withColumn("readable", F.lit(True))
        rows = rows.unionByName(bad.select("seq", F.lit(False).alias("readable")), allowMissingColumns=True)
        return comparable(rows)

    return query


def _store(spark: SparkSession, sf_dir: str) -> str:
    """The log table stored by day, in the shared folder."""
    path = shared_dir(spark, "logs")
    logs = event_logs(spark, sf_dir).withColumn("log_date", F.col("timestamp").cast("date"))
    logs.write.partitionBy("log_date").parquet(path)
    return path


def _scan_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_historical(
        spark, _store(spark, sf_dir), FilterSpec(subsystem="com.app.net", level="default"),
        include_source=True, start="2024-01-10 06:00:00", end="2024-01-12 18:00:00",
    )
    return comparable(found.select("seq", "timestamp", "processName", "level", "message", "source"))


def _scan_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text archive: written as raw lines, read back and numbered."""
    path = shared_dir(spark, "archive")
    _raw_json(event_logs(spark, sf_dir)).orderBy("seq").select("value").write.text(path)
    found = scan_archive(spark, path, FilterSpec(process="Finder"), format="text")
    return comparable(found.select("seq", "timestamp", "pid", "level", "message", "source"))


def _spilled(spark: SparkSession, sf_dir: str) -> str:
    path = shared_dir(spark, "spill")
    write_spill(event_logs(spark, sf_dir), path)
    return path


def _write_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything a written spill says, read back."""
    return comparable(replay_spill(spark, _spilled(spark, sf_dir)))


def _replay_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = FilterSpec(process="FINDER,dock", level="info", exclude_grep="purch")
    found = replay_spill(spark, _spilled(spark, sf_dir), spec)
    return comparable(found.select("seq", "timestamp", "processName", "level", "message", "signpostID"))


def _written_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer about errors, and what the file beside it holds."""
    path = shared_dir(spark, "rest")
    errors = scan_filter(event_logs(spark, sf_dir), FilterSpec(level="error"))
    answer = written_envelope(errors, path, threshold=20, k=5)
    rest = replay_spill(spark, path).agg(
        F.count("*").alias("written"), F.min("timestamp").alias("since"), F.max("timestamp").alias("until")
    )
    shown = answer.select("count", "truncated", F.size("head").alias("head"), F.size("tail").alias("tail"), F.col("output_file").isNotNull().alias("written_out"))
    return comparable(shown.crossJoin(rest))


def _structured_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON rows taken apart again."""
    lines = structured_json(event_logs(spark, sf_dir))
    keys = ["timestamp", "process", "pid", "level", "subsystem", "source", "signpostName"]
    return lines.select(*[F.get_json_object("value", f"$.{key}").alias(key) for key in keys])


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of log rows."""
    schema = table(spark, sf_dir, "events").schema
    return as_logs(stream_table(spark, sf_dir, schema, pathGlobFilter="events.parquet"))


NOW = {"availableNow": True}


def _stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tail")
    rows = stream_tail(_live(spark, sf_dir), FilterSpec(subsystem="com.app.net", grep="err|sign"))
    writer = rows.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(**NOW)
    writer.format("parquet").start(path).awaitTermination()
    return comparable(spark.read.schema(rows.schema).parquet(path).select("seq", "timestamp", "message", "subsystem"))


# Parts that the events arrive in, a micro-batch each, and the fewest rows of a file of a part that is cut into several.
LANDINGS, ROWS_A_FILE = 6, 50_000


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events cut into parts by id."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).head()[0] or 0
    return [events.where(F.expr(f"event_id * {LANDINGS} div {last + 1} = {k}")) for k in range(LANDINGS)]


def _landed(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """The parts of the events, written one after the other, as they would land in a folder."""
    path = shared_dir(spark, name)
    for part in _parts(spark, sf_dir):
        write(part, path)
    return path


def _landing(spark: SparkSession, sf_dir: str, rows_a_file: int | None = ROWS_A_FILE) -> DataFrame:
    """The events table as a stream of log rows in several micro-batches.

    A batch is as many files as a part has, so all parts have equally many: as many as the smallest
    fills, dealt row by row. Rows of a batch have their order in `seq`, whichever file they are in.
    """
    files = 1
    if rows_a_file is not None:
        files = min(part.count() for part in _parts(spark, sf_dir)) // rows_a_file
        files = max(1, min(files, task_count(table(spark, sf_dir, "events"))))

    def write(part: DataFrame, path: str) -> None:
        part.repartition(files).sortWithinPartitions("event_id").write.mode("append").parquet(path)

    path = _landed(spark, sf_dir, "landed", write)
    schema = table(spark, sf_dir, "events").schema
    if files > 1 and len(spark.read.schema(schema).parquet(path).inputFiles()) != files * LANDINGS:
        return _landing(spark, sf_dir, None)  # a part that came to other files would shift the batches
    return as_logs(stream_table(spark, path, schema, maxFilesPerTrigger=files))


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "dedup")
    stream_dedup(_landing(spark, sf_dir), path, f"{path}-checkpoint", **NOW).awaitTermination()
    return comparable(dedup_result(spark, path).select("seq", "message", "repeat_count"))


def _stream_signposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "signposts")
    stream_signposts(_landing(spark, sf_dir), path, f"{path}-checkpoint", **NOW).awaitTermination()
    return comparable(signpost_summary(intervals_of(signposts_result(spark, path))))


def _stream_signpost_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "signposts")
    stream_signposts(_landing(spark, sf_dir), path, f"{path}-checkpoint", **NOW).awaitTermination()
    return comparable(signposts_result(spark, path).select("seq", "signpostType", "state", F.col("end").alias("end_time")))


def _captured_signposts(spark: SparkSession, sf_dir: str):
    path = shared_dir(spark, "intervals")
    spec = FilterSpec(subsystem="com.app")
    return capture_signposts(_landing(spark, sf_dir), path, f"{path}-checkpoint", spec, seconds=3600, most=CAPTURED, **NOW)


# Events that the capture of intervals stops at.
CAPTURED = 300


def _capture_signposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = _captured_signposts(spark, sf_dir)
    return answer.report.header.drop("hint").withColumns(
        {"stop_reason": F.lit(answer.stop_reason), "events": F.lit(answer.events).cast("long")}
    )


def _capture_signposts_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_captured_signposts(spark, sf_dir).report.intervals)


def _tailed(spark: SparkSession, sf_dir: str) -> str:
    """Raw lines of both layouts that arrive in several files, followed into a table."""
    def write(part: DataFrame, path: str) -> None:
        # Lines are made where the rows are read; only their text goes to the one task that writes the file.
        lines = _mixed_lines(as_logs(part)).repartition(1).sortWithinPartitions("seq")
        lines.select("value").write.mode("append").text(path)

    source = _landed(spark, sf_dir, "lines", write)
    path = shared_dir(spark, "tailed")
    write_lines(spark, source, path, f"{path}-checkpoint", {"maxFilesPerTrigger": 1}, **NOW).awaitTermination()
    return path


def _stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tailed_rows(spark, _tailed(spark, sf_dir), FilterSpec(level="default"))
    return comparable(found.select("seq", "timestamp", "processName", "level", "message"))


def _stream_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tailed_bad(spark, _tailed(spark, sf_dir)).select("seq")


def _summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "summary")
    write_summary(_landing(spark, sf_dir), path, f"{path}-checkpoint", merged_after=3, **NOW).awaitTermination()
    return read_summary(spark, path)


def _stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_counts(_summary_table(spark, sf_dir))


def _stream_summary_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = summary_of(_summary_table(spark, sf_dir))
    return comparable(answer.select("count", F.col("time_range.start").alias("range_start"), F.col("time_range.end").alias("range_end")))


def _capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "capture")
    rows = stream_tail(_live(spark, sf_dir), FilterSpec(level="error"))
    answer = capture_stream(rows, path, f"{path}-checkpoint", timeout="600s", count=120, **NOW)
    taken = spark.read.parquet(path).select("seq", "message")
    return taken.withColumn("stop_reason", F.lit(answer.stop_reason))


QUERIES = {
    "ingest_ndjson": _ingested(ingest_ndjson, _raw_json),
    "ingest_legacy_text": _ingested(ingest_legacy_text, _raw_text),
    "ingest_mixed": _ingested(ingest_mixed, _mixed_lines),
    "scan_historical": _scan_historical,
    "scan_archive": _scan_archive,
    "write_spill": _write_spill,
    "replay_spill": _replay_spill,
    "written_envelope": _written_envelope,
    "structured_output": lambda spark, sf_dir: comparable(structured_output(event_logs(spark, sf_dir))),
    "structured_json": _structured_json,
    "source_projection": lambda spark, sf_dir: source_projection(event_logs(spark, sf_dir)).select("seq", "source"),
    "stream_tail": _stream_tail,
    "stream_dedup": _stream_dedup,
    "stream_signposts": _stream_signposts,
    "stream_signpost_states": _stream_signpost_states,
    "capture_signposts": _capture_signposts,
    "capture_signposts_intervals": _capture_signposts_intervals,
    "stream_lines": _stream_lines,
    "stream_bad_lines": _stream_bad_lines,
    "stream_summary": _stream_summary,
    "stream_summary_bounds": _stream_summary_bounds,
    "capture_stream": _capture_stream,
}

_BODY = "timestamp, processName, pid, subsystem, category, level, message, threadID, eventType, source, signpostID, signpostName, signpostType"
_NULLS = ", ".join(f"NULL AS {name}" for name in _BODY.split(", "))
_FROM_JSON = """timestamp, processName, pid, subsystem, category, level, 'say "hi", ' || message AS message,
    threadID, eventType, CASE WHEN threadID % 6 = 0 THEN 'Core main.c' || CASE WHEN threadID > 0 THEN ':' || threadID ELSE '' END END
    AS source, CAST(signpostID AS VARCHAR) AS signpostID, signpostName, signpostType"""
_FROM_TEXT = """timestamp, CASE WHEN threadID % 7 = 0 THEN 'unknown' ELSE processName END AS processName,
    CASE WHEN threadID % 7 = 0 THEN 0 ELSE pid END AS pid,
    CASE WHEN threadID % 7 = 3 THEN 'com.example.app' WHEN threadID % 7 > 3 THEN coalesce(subsystem, 'none') END AS subsystem,
    CAST(NULL AS VARCHAR) AS category, CASE WHEN threadID % 7 IN (0, 1, 3) THEN 'Default' ELSE level END AS level,
    CASE WHEN threadID % 7 = 0 THEN 'no process here: ' || message ELSE message END AS message,
    CAST(NULL AS BIGINT) AS threadID, CAST(NULL AS VARCHAR) AS eventType, CAST(NULL AS VARCHAR) AS source,
    CAST(NULL AS VARCHAR) AS signpostID, CAST(NULL AS VARCHAR) AS signpostName, CAST(NULL AS VARCHAR) AS signpostType"""
_GOOD_JSON = "threadID % 36 NOT IN (1, 7, 13, 19, 25, 31)"
_BAD_JSON = "threadID % 36 IN (1, 7, 13, 19, 31)"
_ARRIVED = f"{LOGS_CTE}, arrived AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS line FROM logs)"

ORACLES = {
    "ingest_ndjson": f"""{LOGS_CTE} SELECT seq, {_FROM_JSON}, true AS readable FROM logs WHERE {_GOOD_JSON}
        UNION ALL SELECT seq, {_NULLS}, false FROM logs WHERE {_BAD_JSON}""",
    "ingest_legacy_text": f"""{LOGS_CTE} SELECT seq, {_FROM_TEXT}, true AS readable FROM logs WHERE threadID % 7 <> 6
        UNION ALL SELECT seq, {_NULLS}, false FROM logs WHERE threadID % 7 = 6""",
    "ingest_mixed": f"""{LOGS_CTE} SELECT seq, {_FROM_JSON}, true AS readable FROM logs WHERE seq % 2 = 0 AND {_GOOD_JSON}
        UNION ALL SELECT seq, {_FROM_TEXT}, true FROM logs WHERE seq % 2 = 1 AND threadID % 7 <> 6
        UNION ALL SELECT seq, {_NULLS}, false FROM logs
            WHERE (seq % 2 = 0 AND {_BAD_JSON}) OR (seq % 2 = 1 AND threadID % 7 = 6)""",
    "scan_historical": f"""{LOGS_CTE} SELECT seq, timestamp, processName, level, message, source FROM logs
        WHERE timestamp >= TIMESTAMP '2024-01-10 06:00:00' AND timestamp <= TIMESTAMP '2024-01-12 18:00:00'
        AND starts_with(subsystem, 'com.app.net') AND level IN ('Default', 'Error', 'Fault') AND eventType <> 'signpostEvent'""",
    "scan_archive": f"""{LOGS_CTE} SELECT seq, timestamp, pid, level, 'say "hi", ' || message AS message,
        CAST(NULL AS VARCHAR) AS source FROM logs WHERE {_GOOD_JSON} AND processName = 'Finder'
        AND level NOT IN ('Debug', 'Info') AND eventType <> 'signpostEvent'""",
    "write_spill": f"{LOGS_CTE} SELECT * REPLACE (CAST(signpostID AS VARCHAR) AS signpostID) FROM logs",
    "replay_spill": f"""{LOGS_CTE} SELECT seq, timestamp, processName, level, message, CAST(signpostID AS VARCHAR) AS signpostID
        FROM logs WHERE processName IN ('Finder', 'Dock') AND level <> 'Debug' AND NOT contains(message, 'purch')""",
    "written_envelope": f"""{LOGS_CTE}, errors AS (SELECT * FROM logs WHERE level IN ('Error', 'Fault'))
        SELECT count(*) AS count, count(*) > 10 AS truncated, CAST(5 AS INT) AS head, CAST(5 AS INT) AS tail, true AS written_out,
            count(*) AS written, min(timestamp) AS since, max(timestamp) AS until FROM errors""",
    "structured_output": f"""{LOGS_CTE} SELECT timestamp, processName AS process, pid, level, message, subsystem, category,
        threadID, activityID, processImagePath, senderImagePath, traceID, eventType, source FROM logs""",
    "structured_json": f"""{LOGS_CTE} SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
        processName AS process, CAST(pid AS VARCHAR) AS pid, level, subsystem, source, CAST(NULL AS VARCHAR) AS signpostName
        FROM logs""",
    "source_projection": f"{LOGS_CTE} SELECT seq, CAST(NULL AS VARCHAR) AS source FROM logs",
    "stream_tail": f"""{LOGS_CTE} SELECT seq, timestamp, message, subsystem FROM logs
        WHERE starts_with(subsystem, 'com.app.net') AND eventType <> 'signpostEvent' AND regexp_matches(message, 'err|sign', 'i')""",
    "stream_lines": f"""{_ARRIVED} SELECT line AS seq, timestamp, processName, level, message FROM (
            SELECT line, {_FROM_JSON} FROM arrived WHERE seq % 2 = 0 AND {_GOOD_JSON}
            UNION ALL SELECT line, {_FROM_TEXT} FROM arrived WHERE seq % 2 = 1 AND threadID % 7 <> 6)
        WHERE level IN ('Default', 'Error', 'Fault') AND coalesce(eventType, '') <> 'signpostEvent'""",
    "stream_bad_lines": f"""{_ARRIVED} SELECT line AS seq FROM arrived
        WHERE (seq % 2 = 0 AND {_BAD_JSON}) OR (seq % 2 = 1 AND threadID % 7 = 6)""",
    "stream_summary": f"""{LOGS_CTE} SELECT 'level' AS dimension, level AS name, count(*) AS count FROM logs GROUP BY level
        UNION ALL SELECT 'processName', processName, count(*) FROM logs GROUP BY processName
        UNION ALL SELECT 'subsystem', subsystem, count(*) FROM logs WHERE subsystem <> '' GROUP BY subsystem
        UNION ALL SELECT 'category', category, count(*) FROM logs WHERE category <> '' GROUP BY category""",
    "stream_summary_bounds": f"""{LOGS_CTE} SELECT count(*) AS count, arg_min(timestamp, seq) AS range_start,
        arg_max(timestamp, seq) AS range_end FROM logs""",
    "capture_stream": f"""{LOGS_CTE} SELECT seq, message, 'count' AS stop_reason FROM logs
        WHERE level IN ('Error', 'Fault') AND eventType <> 'signpostEvent' ORDER BY seq LIMIT 120""",
}
