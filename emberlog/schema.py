"""The one row type every operator works on, and the fixed values around it."""

from pyspark.sql import types as T

# Severity names in ascending order, and the numeric codes the log store uses.
LEVELS = ["Debug", "Info", "Default", "Error", "Fault"]
LEVEL_CODES = {"Debug": 0, "Info": 1, "Default": 2, "Error": 16, "Fault": 17}

# The kinds of interval event, and the event type that marks one.
SIGNPOST_TYPES = ["begin", "end", "event"]
SIGNPOST_EVENT = "signpostEvent"

UNKNOWN_PROCESS = "unknown"

# Signpost ids are unsigned 64-bit, so they need more room than a BIGINT has.
UINT64 = T.DecimalType(20, 0)
UINT64_MAX = "18446744073709551615"

LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("processName", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("subsystem", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("threadID", T.LongType()),
        T.StructField("activityID", T.LongType()),
        T.StructField("traceID", T.LongType()),
        T.StructField("processImagePath", T.StringType()),
        T.StructField("senderImagePath", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("signpostID", UINT64),
        T.StructField("signpostName", T.StringType()),
        T.StructField("signpostType", T.StringType()),
        T.StructField("signpostScope", T.StringType()),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# One NDJSON line as the log store prints it.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("processImagePath", T.StringType()),
        T.StructField("processID", T.LongType()),
        T.StructField("senderImagePath", T.StringType()),
        T.StructField("subsystem", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("messageType", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("eventMessage", T.StringType()),
        T.StructField("activityIdentifier", T.LongType()),
        T.StructField("threadID", T.LongType()),
        T.StructField("traceID", T.LongType()),
        T.StructField(
            "source",
            T.StructType(
                [
                    T.StructField("symbol", T.StringType()),
                    T.StructField("file", T.StringType()),
                    T.StructField("line", T.LongType()),
                    T.StructField("image", T.StringType()),
                ]
            ),
        ),
        T.StructField("signpostID", UINT64),
        T.StructField("signpostName", T.StringType()),
        T.StructField("signpostType", T.StringType()),
        T.StructField("signpostScope", T.StringType()),
    ]
)

# A line of an earlier result (spill): canonical names without the arrival number.
SPILL_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()) if f.name == "timestamp" else f
        for f in LOG_SCHEMA.fields
        if f.name != "seq"
    ]
)
SPILL_REQUIRED = ["timestamp", "processName", "pid", "level", "message"]
