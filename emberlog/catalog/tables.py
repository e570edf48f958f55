"""Log tables derived from the given tables, by expressions both engines read the same way."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_PROCESS = (
    "CASE user_id % 5 WHEN 0 THEN 'Finder' WHEN 1 THEN 'Dock' WHEN 2 THEN 'MyApp' "
    "WHEN 3 THEN 'mdworker' ELSE 'kernel' END"
)
_PAIRED = "event_type IN ('click', 'view', 'purchase')"

# `events` as logs: five levels, five processes, three of five event types as interval events.
EVENT_LOGS = {
    "seq": "event_id",
    "timestamp": "ts",
    "processName": _PROCESS,
    "pid": "CAST(1000 + user_id % 10 AS BIGINT)",
    "subsystem": (
        "CASE user_id % 4 WHEN 0 THEN 'com.app.net' WHEN 1 THEN 'com.app.net.http' "
        "WHEN 2 THEN 'com.app.db' ELSE NULL END"
    ),
    "category": f"CASE {_K} % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'query' WHEN 2 THEN '' ELSE NULL END",
    "level": (
        "CASE event_type WHEN 'click' THEN 'Debug' WHEN 'view' THEN 'Info' WHEN 'signup' THEN 'Default' "
        "WHEN 'purchase' THEN 'Error' ELSE 'Fault' END"
    ),
    "message": "event_type",
    "threadID": "user_id",
    "activityID": "CASE WHEN user_id % 3 = 0 THEN event_id * 7 END",
    "traceID": "CAST(NULL AS BIGINT)",
    "processImagePath": f"'/Applications/' || {_PROCESS}",
    "senderImagePath": "CASE WHEN user_id % 2 = 0 THEN '/usr/lib/libtrace.dylib' END",
    "eventType": f"CASE WHEN {_PAIRED} THEN 'signpostEvent' ELSE 'logEvent' END",
    "source": "CASE WHEN user_id % 6 = 0 THEN 'Core main.c:' || CAST(user_id AS STRING) END",
    "signpostID": f"CASE WHEN {_PAIRED} THEN CAST(user_id % 10 AS DECIMAL(20,0)) END",
    "signpostName": f"CASE WHEN {_PAIRED} THEN 'op' || CAST({_K} % 4 AS STRING) END",
    "signpostType": "CASE event_type WHEN 'click' THEN 'begin' WHEN 'view' THEN 'end' WHEN 'purchase' THEN 'event' END",
    "signpostScope": f"CASE WHEN {_PAIRED} THEN 'process' END",
}

# `events` as interval events whose ids are used once: a begin and an end each, of which every fifth event is missing.
SINGLE_USE_LOGS = EVENT_LOGS | {
    "pid": "CAST(1000 + CAST(floor(event_id / 2) AS BIGINT) % 10 AS BIGINT)",
    "eventType": "CASE WHEN event_id % 5 = 0 THEN 'logEvent' ELSE 'signpostEvent' END",
    "signpostID": "CAST(floor(event_id / 2) AS DECIMAL(20,0))",
    "signpostName": "'op'",
    "signpostType": "CASE WHEN event_id % 2 = 0 THEN 'begin' ELSE 'end' END",
}

# `documents` as logs with long messages in several languages.
DOCUMENT_LOGS = {
    "seq": "doc_id",
    "processName": "lang",
    "subsystem": "source",
    "message": "text",
}


def _selected(columns: dict[str, str], table: str) -> str:
    listed = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return f"SELECT {listed} FROM {table}"


SINGLE_USE_CTE = f"WITH logs AS ({_selected(SINGLE_USE_LOGS, 'events')})"
LOGS_CTE = f"WITH logs AS ({_selected(EVENT_LOGS, 'events')})"
DOCUMENTS_CTE = f"WITH logs AS ({_selected(DOCUMENT_LOGS, 'documents')})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_logs(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{expression} AS {name}" for name, expression in EVENT_LOGS.items()])


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(table(spark, sf_dir, "events"))


def single_use_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.selectExpr(*[f"{expression} AS {name}" for name, expression in SINGLE_USE_LOGS.items()])


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.selectExpr(*[f"{expression} AS {name}" for name, expression in DOCUMENT_LOGS.items()])


def comparable(df: DataFrame) -> DataFrame:
    """Types both engines hand over alike: times without a zone, wide ids as text."""
    changes = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "timestamp":
            changes[f.name] = F.col(f.name).cast("timestamp_ntz")
        elif kind.startswith("decimal"):
            changes[f.name] = F.col(f.name).cast("string")
    return df.withColumns(changes) if changes else df
