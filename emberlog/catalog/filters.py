"""Queries over row filters, with their SQL twins."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalog.tables import DOCUMENTS_CTE, LOGS_CTE, document_logs, event_logs, table
from emberlog.operators import filters as f
from emberlog.operators.filters import FilterSpec
from emberlog.operators.profiles import Profile, profile_match, summarise_matches


def _kept(build, columns=("seq", "level", "processName", "subsystem", "category")):
    """A query returning the rows a predicate keeps; predicates are built when it runs."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return event_logs(spark, sf_dir).where(build()).select(*columns)

    return query


def _kept_sql(condition: str) -> str:
    return f"{LOGS_CTE} SELECT seq, level, processName, subsystem, category FROM logs WHERE {condition}"


def _documents(build):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return document_logs(spark, sf_dir).where(build()).select("seq", "processName")

    return query


def _filtered(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(event_logs(spark, sf_dir)).select("seq", "level", "processName", "subsystem", "category")

    return query


def _chain() -> Column:
    parts = [f.process_ci("finder"), f.pid_eq(1000), f.subsystem_prefix(["com.app"])]
    return f.filter_chain([*parts, f.min_level("default"), f.exclude_grep("^sign")])


PROFILES = {
    "errors": Profile(level="error"),
    "net": Profile(subsystem="com.app.net, com.other", exclude_grep="click"),
    "finder": Profile(process="finder,DOCK", pid=1001),
    "queries": Profile(category="query", level="nonsense", grep="^(view|PURCHASE)$"),
    "everything": Profile(),
}


def _profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_match(event_logs(spark, sf_dir), PROFILES, Profile(info=True)).select("seq", "profile")


# Suppliers as saved filters, a rule each, of all kinds.
RULES = {
    "profile": "'r' || s_suppkey",
    "pid": "CASE WHEN s_suppkey % 8 IN (0, 7) THEN CAST(1000 + s_suppkey % 10 AS BIGINT) END",
    "process": "CASE s_suppkey % 8 WHEN 1 THEN ' finder,Dock,FINDER' WHEN 7 THEN 'myapp' END",
    "subsystem": "CASE s_suppkey % 8 WHEN 2 THEN 'com.app.net' WHEN 3 THEN 'com.app.net.http, com.app' END",
    "category": "CASE WHEN s_suppkey % 8 IN (1, 4) THEN 'http,query' END",
    "level": "CASE s_suppkey % 8 WHEN 0 THEN 'error' WHEN 4 THEN 'Default' WHEN 5 THEN 'fault' WHEN 6 THEN 'loud' END",
    "grep": "CASE s_suppkey % 8 WHEN 2 THEN '^(view|ERR)' WHEN 6 THEN 'purchase' END",
    "exclude_grep": "CASE s_suppkey % 8 WHEN 3 THEN 'CLICK' END",
}


def _match_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "supplier").selectExpr(*[f"{rule} AS {name}" for name, rule in RULES.items()])
    return summarise_matches(event_logs(spark, sf_dir), rules)


QUERIES = {
    "process_ci": _kept(lambda: f.process_ci("FINDER") | f.process_ci("Dock", case_sensitive=True)),
    "process_path_suffix": _kept(lambda: f.process_path_suffix(["Finder", "dock", "kernel"])),
    "pid_eq": _kept(lambda: f.pid_eq(1003)),
    "subsystem_exact": _kept(lambda: f.subsystem_exact("com.app.net")),
    "subsystem_prefix": _kept(lambda: f.subsystem_prefix(["com.app.n", "com.app.db"])),
    "category_eq": _kept(lambda: f.category_eq(["http", "query"])),
    "min_level": _kept(lambda: f.min_level("error")),
    "signposts_only": _kept(f.signposts_only),
    "grep": _documents(lambda: f.grep("(ther|être)[a-zé]*\\.")),
    "exclude_grep": _documents(lambda: f.exclude_grep("(ther|être)[a-zé]*\\.")),
    "not_pred": _kept(lambda: f.not_pred(F.col("subsystem") == "com.app.net")),
    "any_of": _kept(lambda: f.any_of([f.pid_eq(1001), f.min_level("fault"), f.category_eq(["http"])]) & f.any_of([])),
    "filter_chain": _kept(_chain),
    "emission_filter": _filtered(lambda logs: f.emission_filter(logs, FilterSpec(process="Finder", info=True))),
    "signpost_visibility": _filtered(lambda logs: f.signpost_visibility(logs)),
    "scan_filter": _filtered(
        lambda logs: f.scan_filter(
            logs,
            FilterSpec(
                process="finder,MyApp", subsystem=["com.app.net"], category="http,query", level="info", grep="e",
                exclude_grep="err",
            ),
        )
    ),
    "scan_filter_live": _filtered(
        lambda logs: f.scan_filter(logs, FilterSpec(process="finder,MyApp,Dock", subsystem="com.app"), mode="live")
    ),
    "signpost_filter": _filtered(
        lambda logs: f.signpost_filter(
            logs, FilterSpec(subsystem="com.app.net", level="fault", grep="zzz", signpost=True)
        )
    ),
    "time_range": _filtered(
        lambda logs: f.time_range(logs, start="2024-01-05 00:00:00", end="2024-01-20 12:30:00.5")
    ),
    "time_range_last": _filtered(lambda logs: f.time_range(logs, last="36h", now="2024-01-20 12:30:00")),
    "time_range_boot": _filtered(lambda logs: f.time_range(logs, last="boot", boot="2024-01-25 00:00:00")),
    "profile_match": _profile_match,
    "match_profiles": _match_profiles,
}

ORACLES = {
    "process_ci": _kept_sql("lower(processName) = 'finder' OR processName = 'Dock'"),
    "process_path_suffix": _kept_sql(
        "processImagePath LIKE '%/Finder' OR processImagePath LIKE '%/dock' OR processImagePath LIKE '%/kernel'"
    ),
    "pid_eq": _kept_sql("pid = 1003"),
    "subsystem_exact": _kept_sql("subsystem = 'com.app.net'"),
    "subsystem_prefix": _kept_sql("starts_with(subsystem, 'com.app.n') OR starts_with(subsystem, 'com.app.db')"),
    "category_eq": _kept_sql("category IN ('http', 'query')"),
    "min_level": _kept_sql("level IN ('Error', 'Fault')"),
    "signposts_only": _kept_sql("eventType = 'signpostEvent'"),
    "grep": (
        f"{DOCUMENTS_CTE} SELECT seq, processName FROM logs "
        "WHERE regexp_matches(message, '(ther|être)[a-zé]*\\.', 'i')"
    ),
    "exclude_grep": (
        f"{DOCUMENTS_CTE} SELECT seq, processName FROM logs "
        "WHERE NOT regexp_matches(message, '(ther|être)[a-zé]*\\.', 'i')"
    ),
    "not_pred": _kept_sql("NOT coalesce(subsystem = 'com.app.net', false)"),
    "any_of": _kept_sql("pid = 1001 OR level = 'Fault' OR category = 'http'"),
    "filter_chain": _kept_sql(
        "lower(processName) = 'finder' AND pid = 1000 AND starts_with(subsystem, 'com.app') "
        "AND level IN ('Default', 'Error', 'Fault') AND NOT regexp_matches(message, '^sign', 'i')"
    ),
    "emission_filter": _kept_sql("level <> 'Debug'"),
    "signpost_visibility": _kept_sql("eventType IS NULL OR eventType <> 'signpostEvent'"),
    "scan_filter": _kept_sql(
        "lower(processName) IN ('finder', 'myapp') AND starts_with(subsystem, 'com.app.net') "
        "AND category IN ('http', 'query') AND level <> 'Debug' AND regexp_matches(message, 'e', 'i') "
        "AND NOT regexp_matches(message, 'err', 'i')"
    ),
    "scan_filter_live": _kept_sql(
        "processName IN ('MyApp', 'Dock') AND starts_with(subsystem, 'com.app') AND eventType <> 'signpostEvent'"
    ),
    "signpost_filter": _kept_sql("eventType = 'signpostEvent' AND starts_with(subsystem, 'com.app.net')"),
    "time_range": _kept_sql(
        "timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 12:30:00.5'"
    ),
    "time_range_last": _kept_sql("timestamp >= TIMESTAMP '2024-01-20 12:30:00' - INTERVAL 36 HOUR"),
    "time_range_boot": _kept_sql("timestamp >= TIMESTAMP '2024-01-25 00:00:00'"),
    "profile_match": f"""{LOGS_CTE}
        SELECT seq, 'errors' AS profile FROM logs WHERE level IN ('Error', 'Fault')
        UNION ALL SELECT seq, 'net' FROM logs
            WHERE starts_with(subsystem, 'com.app.net') AND NOT regexp_matches(message, 'click', 'i')
        UNION ALL SELECT seq, 'finder' FROM logs WHERE lower(processName) IN ('finder', 'dock') AND pid = 1001
        UNION ALL SELECT seq, 'queries' FROM logs
            WHERE category = 'query' AND regexp_matches(message, '^(view|PURCHASE)$', 'i')
        UNION ALL SELECT seq, 'everything' FROM logs""",
    "match_profiles": f"""{LOGS_CTE}, rules AS (SELECT {', '.join(f'{rule} AS {name}' for name, rule in RULES.items())} FROM supplier)
        SELECT profile, count(*) AS n, min(seq) AS first, max(seq) AS last, CAST(sum(seq) AS BIGINT) AS total
        FROM logs JOIN rules ON (rules.pid IS NULL OR logs.pid = rules.pid)
            AND (process IS NULL OR list_contains(string_split(lower(trim(process)), ','), lower(processName)))
            AND (rules.subsystem IS NULL OR len([p FOR p IN string_split(rules.subsystem, ',')
                IF starts_with(logs.subsystem, trim(p))]) > 0)
            AND (rules.category IS NULL OR list_contains(string_split(rules.category, ','), logs.category))
            AND (rules.level IS NULL OR lower(rules.level) = 'loud' OR CASE lower(rules.level)
                WHEN 'error' THEN logs.level IN ('Error', 'Fault') WHEN 'fault' THEN logs.level = 'Fault'
                ELSE logs.level IN ('Default', 'Error', 'Fault') END)
            AND (grep IS NULL OR regexp_matches(message, grep, 'i'))
            AND (exclude_grep IS NULL OR NOT regexp_matches(message, exclude_grep, 'i'))
        GROUP BY profile""",
}
