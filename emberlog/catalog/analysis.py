"""Queries over aggregates, intervals, ordered operators and bounded answers, with their SQL twins."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalog.tables import LOGS_CTE, SINGLE_USE_CTE, comparable, event_logs, single_use_logs, table
from emberlog.operators import limits, ordered, signposts, summary
from emberlog.operators.coverage import coverage_matrix, coverage_table, redaction_check, redaction_table
from emberlog.operators.filters import FilterSpec, grep, scan_filter
from emberlog.operators.inventory import distinct_first, process_inventory
from emberlog.plans.capture import bounded_capture, capture_report, capture_status
from emberlog.plans.envelope import result_envelope, retained_rows
from emberlog.plans.signpost_report import signpost_report


def _on(operator, load=event_logs):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(operator(load(spark, sf_dir)))

    return query


def _text(buckets: str) -> Column:
    """A list of (name, count) as `a=2,b=1`."""
    return F.array_join(F.transform(buckets, lambda b: F.concat(b["name"], F.lit("="), b["count"].cast("string"))), ",")


def _levels(levels: str) -> Column:
    return _text_of_entries(F.array_sort(F.map_entries(levels)))


def _text_of_entries(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def _summary_columns(prefix: str = "") -> list[Column]:
    at = prefix and f"{prefix}."
    return [
        F.col(f"{at}time_range.start").alias("range_start"),
        F.col(f"{at}time_range.end").alias("range_end"),
        _levels(f"{at}by_level").alias("by_level"),
        _text(f"{at}top_processes").alias("top_processes"),
        _text(f"{at}top_subsystems").alias("top_subsystems"),
        _text(f"{at}top_categories").alias("top_categories"),
    ]


def _seqs(rows: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: r["seq"].cast("string")), ",")


def _shown_envelope(answer: DataFrame, *columns: str) -> DataFrame:
    return answer.select(
        *columns,
        "truncated",
        *_summary_columns("summary"),
        _seqs("entries").alias("entries"),
        _seqs("head").alias("head"),
        _seqs("tail").alias("tail"),
    )


NOTHING = FilterSpec(subsystem="com.nowhere")


def _empty_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hint of three queries that find nothing and one that does."""
    logs = event_logs(spark, sf_dir)
    cases = {
        "subsystem": (NOTHING, None),
        "process": (FilterSpec(process="nobody"), None),
        "short": (FilterSpec(pid=-1), "30s"),
        "found": (FilterSpec(pid=1001), "30s"),
    }
    answers = []
    for name, (spec, last) in cases.items():
        counted = scan_filter(logs, spec).agg(F.count("*").alias("count"))
        answers.append(limits.empty_hint(counted, spec, last).select(F.lit(name).alias("case"), "count", "hint_code"))
    result = answers[0]
    for answer in answers[1:]:
        result = result.unionByName(answer)
    return result


def _union_again(logs: DataFrame) -> DataFrame:
    intervals = signposts.signpost_intervals(logs)
    return signposts.completed_union_open(intervals.where("end is not null"), intervals.where("end is null"))


def _report(logs: DataFrame) -> DataFrame:
    return signpost_report(logs, FilterSpec(subsystem="com.app.net", level="fault", signpost=True)).header.drop("hint")


def _report_empty(logs: DataFrame) -> DataFrame:
    return signpost_report(logs, NOTHING, mode="stream").header.drop("hint")


def _report_intervals(logs: DataFrame) -> DataFrame:
    return signpost_report(logs, FilterSpec(subsystem="com.app.net")).intervals


MARKERS = {f"k{k}": f"|k={k}|" for k in (0, 7, 13, 42, 99)} | {"absent": "|never|"}
CAPTURES = ["click", "view", "signup", "purchase", "error", "nothing"]


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as captured text lines: the event type is the capture, `k` the marker."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS source",
        "'SMOKE|k=' || regexp_extract(props, '[0-9]+', 0) || '| user ' || user_id AS text",
    )


def _benchmark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker texts looked for in the whole text of every document, by language."""
    markers = {"the": " the ", "und": " und ", "brackets": "((", "copyright": "Copyright"}
    return coverage_matrix(table(spark, sf_dir, "documents"), markers, ["en", "de", "fr", "es"], source="lang")


def _place_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that the given tables hold: for every part a text that some documents and events have."""
    parts = table(spark, sf_dir, "part")
    return parts.selectExpr("'m' || p_partkey AS marker", f"{SOUGHT} AS sought")


# Parts as markers: short and long ones, ones that occur and ones that do not.
SOUGHT = """CASE p_partkey % 5 WHEN 0 THEN '|k=' || p_partkey % 120 || '|' WHEN 1 THEN 'user ' || p_partkey
    WHEN 2 THEN CAST(p_partkey AS STRING) WHEN 3 THEN 'k=' || p_partkey % 30 || '| user' ELSE '|' || p_partkey || '||' END"""


def _coverage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_table(_captures(spark, sf_dir), _place_markers(spark, sf_dir), CAPTURES)


def _redaction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction_table(_captures(spark, sf_dir), _place_markers(spark, sf_dir), "user 1")


LIVE = dict(started="2024-01-01 00:00:00")

QUERIES = {
    "count_by_level": _on(summary.count_by_level),
    "top_processes": _on(lambda logs: summary.top_processes(logs, 3)),
    "top_subsystems": _on(summary.top_subsystems),
    "top_categories": _on(summary.top_categories),
    "time_bounds": _on(summary.time_bounds),
    "result_summary": _on(lambda logs: summary.result_summary(logs, 4).select("count", *_summary_columns())),
    "result_summary_empty": _on(
        lambda logs: summary.result_summary(logs.where("pid < 0")).select("count", *_summary_columns())
    ),
    "distinct_first": _on(lambda logs: distinct_first(logs, "threadID").select("threadID", "seq", "message", "level")),
    "process_inventory": _on(process_inventory),
    "process_inventory_filtered": _on(lambda logs: process_inventory(logs, "D")),
    "pairing_state": _on(
        lambda logs: signposts.pairing_state(logs).select("seq", "signpostType", "state", F.col("end").alias("end_time"))
    ),
    "pairing_state_single_use": _on(
        lambda logs: signposts.pairing_state(logs).select("seq", "signpostType", "state", F.col("end").alias("end_time")),
        single_use_logs,
    ),
    "signpost_summary_single_use": _on(
        lambda logs: signposts.signpost_summary(signposts.signpost_intervals(logs)), single_use_logs
    ),
    "signpost_intervals": _on(
        lambda logs: signposts.signpost_intervals(logs).withColumnsRenamed({"start": "start_time", "end": "end_time"})
    ),
    "orphan_ends": _on(lambda logs: signposts.orphan_ends(logs).select("seq", "pid", "signpostName", "signpostID")),
    "completed_union_open": _on(lambda logs: _union_again(logs).select("begin_seq", "name", "duration_us")),
    "signpost_summary": _on(lambda logs: signposts.signpost_summary(signposts.signpost_intervals(logs))),
    "summaries_by_total": _on(
        lambda logs: signposts.summaries_by_total(
            signposts.signpost_summary(signposts.signpost_intervals(logs))
        ).select("name", "total_ms")
    ),
    "signpost_occurrences": _on(
        lambda logs: signposts.signpost_occurrences(signposts.signpost_intervals(logs)).withColumnRenamed(
            "start", "start_time"
        )
    ),
    "intervals_by_start": _on(
        lambda logs: signposts.intervals_by_start(signposts.signpost_intervals(logs)).select("begin_seq", "start", "name").withColumnRenamed("start", "start_time")
    ),
    "last_args": _on(lambda logs: signposts.last_args(signposts.signpost_intervals(logs))),
    "signpost_totals": _on(signposts.signpost_totals),
    "signpost_table": _on(signposts.signpost_table),
    "signpost_footer": _on(signposts.signpost_footer),
    "signpost_report": _on(_report),
    "signpost_report_empty": _on(_report_empty),
    "signpost_report_intervals": _on(_report_intervals),
    "p50": _on(lambda lines: signposts.p50(lines.select("l_partkey", "l_suppkey"), "l_partkey", ("l_suppkey",)),
               lambda spark, sf_dir: table(spark, sf_dir, "lineitem")),
    "dedup_consecutive": _on(
        lambda logs: ordered.dedup_consecutive(logs).select("seq", "message", "repeat_count", "text")
    ),
    "relative_time": _on(lambda logs: ordered.relative_time(logs).select("seq", "delta_us", "relative")),
    "dedup_then_relative": _on(
        lambda logs: ordered.relative_time(ordered.dedup_consecutive(limits.limit_n(logs, 600))).select(
            "seq", "text", "relative"
        )
    ),
    "limit_n": _on(lambda logs: limits.limit_n(logs.where(grep("e.*r")), 321).select("seq", "message")),
    "scan_ceiling": _on(lambda logs: limits.scan_ceiling(logs, 5000).select("seq", "rank", "scan_capped")),
    "head_tail": _on(lambda logs: limits.head_tail(logs, 50, 10).select("seq", "position", "truncated")),
    "list_head_tail": _on(
        lambda customers: limits.list_head_tail(customers.select("c_name", "c_custkey"), ["c_name"], 50, 10),
        lambda spark, sf_dir: table(spark, sf_dir, "customer"),
    ),
    "result_envelope": _on(
        lambda logs: _shown_envelope(
            result_envelope(scan_filter(logs, FilterSpec(level="default")), threshold=50, k=10),
            "count", "scan_capped", "next_since", "hint",
        )
    ),
    "result_envelope_ceiling": _on(
        lambda logs: _shown_envelope(
            result_envelope(scan_filter(logs, FilterSpec(level="default")), limit=200, ceiling=4000, threshold=50, k=10),
            "count", "scan_capped", "next_since", "hint",
        )
    ),
    "result_envelope_plain": _on(
        lambda logs: result_envelope(logs).select("count", "scan_capped", "truncated", "next_since", *_summary_columns("summary"))
    ),
    "result_envelope_full": _on(
        lambda logs: _shown_envelope(
            result_envelope(logs, limit=120, full=True), "count", "scan_capped", "next_since", "hint"
        )
    ),
    "result_envelope_summary_only": _on(
        lambda logs: result_envelope(logs, summary_only=True).select(
            "count", "scan_capped", "next_since", *_summary_columns("summary")
        )
    ),
    "result_envelope_empty": _on(
        lambda logs: _shown_envelope(result_envelope(scan_filter(logs, NOTHING), threshold=50, k=10, spec=NOTHING), "count", "next_since", "hint_code")
    ),
    "retained_rows": _on(lambda logs: retained_rows(logs, 500).select("seq", "message")),
    "empty_hint": _empty_hint,
    "next_since": _on(limits.next_since),
    "tail_cursor": _on(lambda logs: limits.tail_cursor(logs, "2024-01-28 10:00:00").select("seq", "timestamp")),
    "bounded_capture": _on(
        lambda logs: bounded_capture(
            scan_filter(logs, FilterSpec(level="error")), timeout="1h", capture="48h", count=150, **LIVE
        ).select("seq", "message", "stop_reason")
    ),
    "bounded_capture_time": _on(
        lambda logs: bounded_capture(logs, capture="72h").select("seq", "stop_reason")
    ),
    "bounded_capture_timeout": _on(
        lambda logs: capture_status(logs, timeout="24h", started="2023-12-25 00:00:00")
    ),
    "capture_report": _on(
        lambda logs: _shown_envelope(
            capture_report(logs, FilterSpec(subsystem="com.app"), count=100, timeout=3 * 86400, threshold=50, k=10),
            "captured", "requested", "stopped_by",
        )
    ),
    "capture_report_timeout": _on(
        lambda logs: _shown_envelope(
            capture_report(logs, FilterSpec(process="finder,Finder"), timeout=7200, threshold=50, k=10), "captured", "requested", "stopped_by"
        )
    ),
    "coverage_matrix": _on(lambda lines: coverage_matrix(lines, MARKERS, CAPTURES), _captures),
    "coverage_matrix_documents": _benchmark_coverage,
    "redaction_check": _on(lambda lines: redaction_check(lines, MARKERS, "user 1"), _captures),
    "coverage_table": _coverage_table,
    "redaction_table": _redaction_table,
}

_PAIRED = f"""{LOGS_CTE}, paired AS (
    SELECT *, lag(signpostType) OVER w AS before, lead(signpostType) OVER w AS after,
        lead(timestamp) OVER w AS after_time
    FROM logs WHERE eventType = 'signpostEvent' AND signpostType IN ('begin', 'end')
    WINDOW w AS (PARTITION BY pid, signpostName, signpostID ORDER BY seq)
), states AS (
    SELECT *, CASE WHEN signpostType = 'begin' THEN
            CASE WHEN after IS NULL THEN 'in_flight' WHEN after = 'end' THEN 'completed' ELSE 'overwritten' END
        WHEN before = 'begin' THEN 'completed' ELSE 'orphan' END AS state,
        CASE WHEN signpostType = 'begin' AND after = 'end' THEN after_time END AS end_time
    FROM paired
), intervals AS (
    SELECT signpostName AS name, subsystem, category, pid, signpostID, timestamp AS start_time, end_time,
        date_diff('microsecond', timestamp, end_time) AS duration_us,
        date_diff('microsecond', timestamp, end_time) / 1000.0::DOUBLE AS duration_ms, message, seq AS begin_seq
    FROM states WHERE signpostType = 'begin' AND state <> 'overwritten'
), summaries AS (
    SELECT name, arg_min({{'s': subsystem}}, (start_time, begin_seq)).s AS subsystem,
        arg_min({{'s': category}}, (start_time, begin_seq)).s AS category,
        count(*) AS count, count(*) - count(duration_us) AS in_flight,
        min(duration_us) / 1000.0::DOUBLE AS min_ms, round(median(duration_us)) / 1000.0::DOUBLE AS p50_ms,
        max(duration_us) / 1000.0::DOUBLE AS max_ms, CAST(sum(duration_us) AS BIGINT) / 1000.0::DOUBLE AS total_ms,
        CAST(round(median(duration_us)) AS BIGINT) AS p50_us, max(duration_us) AS max_us,
        CAST(sum(duration_us) AS BIGINT) AS total_us,
        coalesce(nullif(arg_max(message, (start_time, begin_seq)), ''), '-') AS last_args
    FROM intervals GROUP BY name
), totals AS (
    SELECT count(*) FILTER (signpostType = 'begin' AND state <> 'overwritten') AS count,
        count(*) FILTER (state = 'in_flight') AS in_flight, count(*) FILTER (state = 'orphan') AS orphan_ends,
        count(*) FILTER (state = 'overwritten') AS overwritten
    FROM states
)"""
_SINGLE_USE = _PAIRED.replace(LOGS_CTE, SINGLE_USE_CTE)
_NET = _PAIRED.replace("WHERE eventType", "WHERE starts_with(subsystem, 'com.app.net') AND eventType")
_NOWHERE = _PAIRED.replace("WHERE eventType", "WHERE starts_with(subsystem, 'com.nowhere') AND eventType")
_SUMMARY = "name, subsystem, category, count, in_flight, min_ms, p50_ms, max_ms, total_ms"
RANKED_SUMMARIES = f"SELECT {_SUMMARY} FROM summaries ORDER BY coalesce(total_us, 0) DESC, name DESC"


def captured_sql(most: int, answer: str) -> str:
    """An answer about the first `most` begin and end events of the com.app subsystems."""
    first = f"""first AS (SELECT * FROM logs WHERE starts_with(subsystem, 'com.app') AND eventType = 'signpostEvent'
        AND signpostType IN ('begin', 'end') ORDER BY seq LIMIT {most}), paired AS ("""
    paired = _PAIRED.replace("paired AS (", first, 1).replace("FROM logs WHERE eventType = 'signpostEvent' AND signpostType IN ('begin', 'end')\n", "FROM first\n")
    return f"{paired} {answer.format(most=most)}"


def _ms(us: str) -> str:
    return (
        f"CASE WHEN {us} IS NULL THEN '-' WHEN {us} >= 100000 THEN ({us} + 500) // 1000 || 'ms' "
        f"ELSE (({us} + 50) // 100) // 10 || '.' || (({us} + 50) // 100) % 10 || 'ms' END"
    )


_RUNS = """marked AS (
    SELECT *, CASE WHEN message IS NOT DISTINCT FROM lag(message) OVER (ORDER BY seq)
        AND row_number() OVER (ORDER BY seq) > 1 THEN 0 ELSE 1 END AS starts FROM {rows}
), islands AS (SELECT *, sum(starts) OVER (ORDER BY seq) AS island FROM marked
), runs AS (
    SELECT min(seq) AS seq, any_value(message) AS message, count(*) AS repeat_count,
        any_value(message) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS text,
        min(timestamp) AS timestamp
    FROM islands GROUP BY island
)"""
_RELATIVE = """CASE WHEN d IS NULL THEN '+0.000s' ELSE CASE WHEN d < 0 THEN '-' ELSE '+' END || CASE
        WHEN a < 60000000 THEN (a + 500) // 1000000 || '.' || lpad(CAST(((a + 500) // 1000) % 1000 AS VARCHAR), 3, '0') || 's'
        WHEN a < 3600000000 THEN m || 'm' || lpad(CAST(h // 100 AS VARCHAR), 2, '0') || '.'
            || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || 's'
        ELSE a // 3600000000 || 'h' || lpad(CAST((a // 60000000) % 60 AS VARCHAR), 2, '0') || 'm' END END"""


def _relative_sql(rows: str, columns: str) -> str:
    return f"""SELECT {columns}, {_RELATIVE} AS relative FROM (
        SELECT *, abs(d) AS a, abs(d) // 60000000 AS m, (abs(d) % 60000000 + 5000) // 10000 AS h FROM (
            SELECT *, date_diff('microsecond', lag(timestamp) OVER (ORDER BY seq), timestamp) AS d FROM {rows}))"""


def _top_sql(column: str, n: int, rows: str = "logs") -> str:
    return (
        f"SELECT {column} AS name, count(*) AS count FROM {rows} WHERE {column} <> '' OR '{column}' = 'processName' "
        f"GROUP BY {column} ORDER BY count DESC, name LIMIT {n}"
    )


def _summary_sql(rows: str, n: int = 10, empty: str = "''") -> str:
    """The summary columns; lists of no rows show as `empty`."""

    def listed(column: str) -> str:
        return (
            f"coalesce((SELECT string_agg(name || '=' || count, ',' ORDER BY count DESC, name) "
            f"FROM ({_top_sql(column, n, rows)})), CASE WHEN EXISTS (FROM {rows}) THEN '' ELSE {empty} END)"
        )

    return f"""(SELECT arg_min(timestamp, seq) FROM {rows}) AS range_start,
        (SELECT arg_max(timestamp, seq) FROM {rows}) AS range_end,
        coalesce((SELECT string_agg(level || '=' || n, ',' ORDER BY level)
            FROM (SELECT level, count(*) AS n FROM {rows} GROUP BY level)), {empty}) AS by_level,
        {listed('processName')} AS top_processes, {listed('subsystem')} AS top_subsystems,
        {listed('category')} AS top_categories"""


def _envelope_sql(rows: str, limit: int | None = None, full: bool = False) -> str:
    """Truncation, summary and samples of `rows`, of which `limit` (or all) are retained."""
    first = f" ORDER BY seq LIMIT {limit}" if limit else ""
    kept = f"(SELECT *, row_number() OVER (ORDER BY seq) AS nth FROM {rows}{first})"
    everything = f"(SELECT count(*) FROM {rows})"
    size = f"least({limit}, {everything})" if limit else everything
    cut = "false" if full else f"({size} > 50)"

    def listed(condition: str) -> str:
        return f"(SELECT string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FROM {kept} WHERE {condition})"

    return f"""(CASE WHEN {cut} THEN least(20, {size}) ELSE {size} END < {everything}) AS truncated, {_summary_sql(rows, empty='NULL')},
        CASE WHEN NOT {cut} THEN coalesce({listed('true')}, '') END AS entries,
        CASE WHEN {cut} THEN {listed('nth <= 10')} END AS head,
        CASE WHEN {cut} THEN {listed(f'nth > {size} - 10')} END AS tail"""


_NEXT = "(SELECT arg_max(timestamp, seq) + INTERVAL 1 MICROSECOND FROM {rows}) AS next_since"
_MARKED = (
    "SELECT event_type AS source, 'SMOKE|k=' || regexp_extract(props, '[0-9]+', 0) || '| user ' || user_id AS text FROM events"
)
_MARKER_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in MARKERS.items())

ORACLES = {
    "count_by_level": f"{LOGS_CTE} SELECT level, count(*) AS count FROM logs GROUP BY level",
    "top_processes": f"{LOGS_CTE} {_top_sql('processName', 3)}",
    "top_subsystems": f"{LOGS_CTE} {_top_sql('subsystem', 10)}",
    "top_categories": f"{LOGS_CTE} {_top_sql('category', 10)}",
    "time_bounds": f"""{LOGS_CTE} SELECT arg_min(timestamp, seq) AS "start", arg_max(timestamp, seq) AS "end" FROM logs""",
    "result_summary": f"{LOGS_CTE} SELECT (SELECT count(*) FROM logs) AS count, {_summary_sql('logs', 4)}",
    "result_summary_empty": f"""{LOGS_CTE}, none AS (SELECT * FROM logs WHERE pid < 0)
        SELECT (SELECT count(*) FROM none) AS count, {_summary_sql('none')}""",
    "distinct_first": f"""{LOGS_CTE} SELECT threadID, min(seq) AS seq, arg_min(message, seq) AS message,
        arg_min(level, seq) AS level FROM logs GROUP BY threadID""",
    "process_inventory": f"{LOGS_CTE} SELECT processName AS name, arg_min(pid, seq) AS pid FROM logs GROUP BY processName",
    "process_inventory_filtered": f"""{LOGS_CTE} SELECT processName AS name, arg_min(pid, seq) AS pid FROM logs
        WHERE contains(lower(processName), 'd') GROUP BY processName""",
    "pairing_state": f"{_PAIRED} SELECT seq, signpostType, state, end_time FROM states",
    "pairing_state_single_use": f"{_SINGLE_USE} SELECT seq, signpostType, state, end_time FROM states",
    "signpost_summary_single_use": f"{_SINGLE_USE} SELECT {_SUMMARY} FROM summaries",
    "signpost_intervals": f"{_PAIRED} SELECT * REPLACE (CAST(signpostID AS VARCHAR) AS signpostID) FROM intervals",
    "orphan_ends": f"""{_PAIRED} SELECT seq, pid, signpostName, CAST(signpostID AS VARCHAR) AS signpostID
        FROM states WHERE state = 'orphan'""",
    "completed_union_open": f"{_PAIRED} SELECT begin_seq, name, duration_us FROM intervals",
    "signpost_summary": f"{_PAIRED} SELECT {_SUMMARY} FROM summaries",
    "summaries_by_total": f"{_PAIRED} SELECT name, total_ms FROM summaries ORDER BY coalesce(total_us, 0) DESC, name DESC",
    "signpost_occurrences": f"""{_PAIRED} SELECT name, start_time, begin_seq, duration_ms, message FROM intervals
        ORDER BY name, start_time, begin_seq""",
    "intervals_by_start": f"{_PAIRED} SELECT begin_seq, start_time, name FROM intervals ORDER BY start_time, begin_seq",
    "last_args": f"{_PAIRED} SELECT name, last_args FROM summaries",
    "signpost_totals": f"{_PAIRED} SELECT * FROM totals",
    "signpost_table": f"""{_PAIRED} SELECT name, count, {_ms('p50_us')} AS p50, {_ms('max_us')} AS max, {_ms('total_us')} AS total, last_args FROM summaries""",
    "signpost_footer": f"{_PAIRED} SELECT in_flight, orphan_ends FROM totals",
    "signpost_report": f"{_NET} SELECT *, 'show' AS mode, CAST(NULL AS VARCHAR) AS hint_code FROM totals",
    "signpost_report_empty": f"""{_NOWHERE} SELECT *, 'stream' AS mode, CASE WHEN count = 0 THEN 'nothing_paired' END AS hint_code FROM totals""",
    "signpost_report_intervals": f"{_NET} {RANKED_SUMMARIES}",
    "p50": """WITH ordered AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS nth,
            count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
        SELECT l_suppkey, max(l_partkey) FILTER (nth = (n + 1) // 2) AS low, max(l_partkey) FILTER (nth = n // 2 + 1) AS high
        FROM ordered GROUP BY l_suppkey""",
    "dedup_consecutive": f"{LOGS_CTE}, {_RUNS.format(rows='logs')} SELECT seq, message, repeat_count, text FROM runs",
    "relative_time": f"{LOGS_CTE} {_relative_sql('logs', 'seq, d AS delta_us')}",
    "dedup_then_relative": f"""{LOGS_CTE}, first AS (SELECT * FROM logs ORDER BY seq LIMIT 600),
        {_RUNS.format(rows='first')} {_relative_sql('runs', 'seq, text')}""",
    "limit_n": f"""{LOGS_CTE} SELECT seq, message FROM logs WHERE regexp_matches(message, 'e.*r', 'i')
        ORDER BY seq LIMIT 321""",
    "scan_ceiling": f"""{LOGS_CTE} SELECT seq, row_number() OVER (ORDER BY seq) AS rank,
        (SELECT count(*) FROM logs) >= 5000 AS scan_capped FROM logs ORDER BY seq LIMIT 5000""",
    "head_tail": f"""{LOGS_CTE}, kept AS (SELECT seq, row_number() OVER (ORDER BY seq) AS nth, count(*) OVER () AS n
            FROM logs)
        SELECT seq, CASE WHEN n <= 50 THEN 'inline' WHEN nth <= 10 THEN 'head' ELSE 'tail' END AS position, n > 50 AS truncated
        FROM kept WHERE n <= 50 OR nth <= 10 OR nth > greatest(n - 10, 10)""",
    "list_head_tail": """WITH kept AS (SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name) AS nth,
            count(*) OVER () AS n FROM customer)
        SELECT c_name, c_custkey, CASE WHEN n <= 50 THEN 'inline' WHEN nth <= 10 THEN 'head' ELSE 'tail' END AS position,
            n > 50 AS truncated FROM kept WHERE n <= 50 OR nth <= 10 OR nth > greatest(n - 10, 10)""",
    "result_envelope": f"""{LOGS_CTE}, seen AS (SELECT * FROM logs WHERE level IN ('Default', 'Error', 'Fault')
            ORDER BY seq)
        SELECT (SELECT count(*) FROM seen) AS count, false AS scan_capped,
            {_NEXT.format(rows='seen')}, CAST(NULL AS VARCHAR) AS hint, {_envelope_sql('seen')}""",
    "result_envelope_ceiling": f"""{LOGS_CTE}, seen AS (SELECT * FROM logs WHERE level IN ('Default', 'Error', 'Fault')
            ORDER BY seq LIMIT 4000)
        SELECT (SELECT count(*) FROM seen) AS count, (SELECT count(*) FROM seen) >= 4000 AS scan_capped,
            {_NEXT.format(rows='seen')}, CAST(NULL AS VARCHAR) AS hint, {_envelope_sql('seen', 200)}""",
    "result_envelope_plain": f"""{LOGS_CTE}
        SELECT (SELECT count(*) FROM logs) AS count, false AS scan_capped, (SELECT count(*) FROM logs) > 0 AS truncated,
            {_NEXT.format(rows='logs')}, {_summary_sql('logs')}""",
    "result_envelope_full": f"""{LOGS_CTE}, seen AS (SELECT * FROM logs)
        SELECT (SELECT count(*) FROM seen) AS count, false AS scan_capped,
            {_NEXT.format(rows='seen')}, CAST(NULL AS VARCHAR) AS hint, {_envelope_sql('seen', 120, full=True)}""",
    "result_envelope_summary_only": f"""{LOGS_CTE}, seen AS (SELECT * FROM logs)
        SELECT (SELECT count(*) FROM seen) AS count, false AS scan_capped,
            {_NEXT.format(rows='seen')}, {_summary_sql('seen')}""",
    "result_envelope_empty": f"""{LOGS_CTE}, seen AS (SELECT * FROM logs WHERE starts_with(subsystem, 'com.nowhere'))
        SELECT (SELECT count(*) FROM seen) AS count, {_NEXT.format(rows='seen')},
            CASE WHEN NOT EXISTS (FROM seen) THEN 'not_persisted' END AS hint_code, {_envelope_sql('seen')}""",
    "retained_rows": f"{LOGS_CTE} SELECT seq, message FROM logs ORDER BY seq LIMIT 500",
    "empty_hint": f"""{LOGS_CTE}
        SELECT 'subsystem' AS "case", count(*) AS count, CASE WHEN count(*) = 0 THEN 'not_persisted' END AS hint_code
            FROM logs WHERE starts_with(subsystem, 'com.nowhere')
        UNION ALL SELECT 'process', count(*), CASE WHEN count(*) = 0 THEN 'process_only' END
            FROM logs WHERE lower(processName) = 'nobody'
        UNION ALL SELECT 'short', count(*), CASE WHEN count(*) = 0 THEN 'short_range' END
            FROM logs WHERE pid = -1
        UNION ALL SELECT 'found', count(*), CASE WHEN count(*) = 0 THEN 'short_range' END
            FROM logs WHERE pid = 1001""",
    "next_since": f"{LOGS_CTE} SELECT {_NEXT.format(rows='logs')}",
    "tail_cursor": f"{LOGS_CTE} SELECT seq, timestamp FROM logs WHERE timestamp >= TIMESTAMP '2024-01-28 10:00:00'",
    "bounded_capture": f"""{LOGS_CTE}, matching AS (SELECT * FROM logs WHERE level IN ('Error', 'Fault')),
        inside AS (SELECT * FROM matching
            WHERE timestamp <= (SELECT arg_min(timestamp, seq) FROM matching) + INTERVAL 48 HOUR)
        SELECT seq, message, CASE WHEN (SELECT count(*) FROM inside) >= 150 THEN 'count'
            WHEN (SELECT count(*) FROM matching) > (SELECT count(*) FROM inside) THEN 'capture' ELSE 'exhausted' END AS stop_reason
        FROM inside WHERE (SELECT arg_min(timestamp, seq) FROM matching) <= TIMESTAMP '2024-01-01 01:00:00'
        ORDER BY seq LIMIT 150""",
    "bounded_capture_time": f"""{LOGS_CTE}, matching AS (SELECT * FROM logs)
        SELECT seq, 'capture' AS stop_reason FROM matching
        WHERE timestamp <= (SELECT arg_min(timestamp, seq) FROM matching) + INTERVAL 72 HOUR""",
    "bounded_capture_timeout": f"""{LOGS_CTE}, matching AS (SELECT * FROM logs),
        first AS (SELECT arg_min(timestamp, seq) > TIMESTAMP '2023-12-26 00:00:00' AS late, count(*) AS n FROM matching)
        SELECT CASE WHEN late THEN 0 ELSE n END AS captured, CASE WHEN late THEN 'timeout' ELSE 'exhausted' END AS stop_reason
        FROM first""",
    "capture_report": f"""{LOGS_CTE}, inside AS (SELECT * FROM logs WHERE starts_with(subsystem, 'com.app')
            AND eventType <> 'signpostEvent'
            AND timestamp <= (SELECT arg_min(timestamp, seq) FROM logs) + INTERVAL 3 DAY ORDER BY seq LIMIT 100)
        SELECT (SELECT count(*) FROM inside) AS captured, CAST(100 AS BIGINT) AS requested,
            CASE WHEN (SELECT count(*) FROM inside) >= 100 THEN 'count' ELSE 'timeout' END AS stopped_by,
            {_envelope_sql('inside')}""",
    "capture_report_timeout": f"""{LOGS_CTE}, inside AS (SELECT * FROM logs WHERE processName = 'Finder'
            AND eventType <> 'signpostEvent' AND level NOT IN ('Debug', 'Info')
            AND timestamp <= (SELECT arg_min(timestamp, seq) FROM logs) + INTERVAL 2 HOUR)
        SELECT (SELECT count(*) FROM inside) AS captured, CAST(NULL AS BIGINT) AS requested, 'timeout' AS stopped_by,
            {_envelope_sql('inside')}""",
    "coverage_matrix": f"""WITH lines AS ({_MARKED}), markers(marker, sought) AS (VALUES {_MARKER_ROWS})
        SELECT marker, {', '.join(
            f"CASE WHEN bool_or(source = '{name}' AND contains(text, sought)) THEN 'YES' ELSE 'no' END AS {name}"
            for name in CAPTURES)}
        FROM lines, markers GROUP BY marker""",
    "coverage_matrix_documents": """WITH markers(marker, sought) AS (
            VALUES ('the', ' the '), ('und', ' und '), ('brackets', '(('), ('copyright', 'Copyright'))
        SELECT marker, CASE WHEN bool_or(lang = 'en' AND contains(text, sought)) THEN 'YES' ELSE 'no' END AS en,
            CASE WHEN bool_or(lang = 'de' AND contains(text, sought)) THEN 'YES' ELSE 'no' END AS de,
            CASE WHEN bool_or(lang = 'fr' AND contains(text, sought)) THEN 'YES' ELSE 'no' END AS fr,
            CASE WHEN bool_or(lang = 'es' AND contains(text, sought)) THEN 'YES' ELSE 'no' END AS es
        FROM documents, markers GROUP BY marker""",
    "coverage_table": f"""WITH lines AS ({_MARKED}), markers AS (SELECT 'm' || p_partkey AS marker, {SOUGHT} AS sought FROM part)
        SELECT marker, {', '.join(
            f"CASE WHEN bool_or(source = '{name}' AND contains(text, sought)) THEN 'YES' ELSE 'no' END AS {name}"
            for name in CAPTURES)}
        FROM lines, markers GROUP BY marker""",
    "redaction_table": f"""WITH lines AS ({_MARKED}), markers AS (SELECT 'm' || p_partkey AS marker, {SOUGHT} AS sought FROM part)
        SELECT source, marker, bool_or(contains(text, 'user 1')) AS leaked
        FROM lines JOIN markers ON contains(text, sought) GROUP BY source, marker""",
    "redaction_check": f"""WITH lines AS ({_MARKED}), markers(marker, sought) AS (VALUES {_MARKER_ROWS})
        SELECT source, marker, bool_or(contains(text, sought)) AS present,
            bool_or(contains(text, sought) AND contains(text, 'user 1')) AS leaked
        FROM lines, markers GROUP BY source, marker""",
}
