"""Small log tables for tests, and where the given tables are."""

import datetime as dt
import os
from decimal import Decimal

from emberlog.schema import LOG_SCHEMA

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

BASE = dt.datetime(2026, 6, 26, 13, 0, 0)
DEFAULTS = {
    "processName": "TestApp", "pid": 42, "level": "Default", "message": "Test message", "timestamp": BASE,
}


def at(seconds: float) -> dt.datetime:
    return BASE + dt.timedelta(microseconds=round(seconds * 1_000_000))


def log_frame(spark, rows: list[dict]):
    """Rows in arrival order; absent columns take the defaults above or null."""
    filled = []
    for seq, row in enumerate(rows):
        row = {"seq": seq, **DEFAULTS, **row}
        if row.get("signpostID") is not None:
            row["signpostID"] = Decimal(row["signpostID"])
        filled.append(tuple(row.get(name) for name in LOG_SCHEMA.fieldNames()))
    return spark.createDataFrame(filled, LOG_SCHEMA)


def event(kind: str, seconds: float, name: str = "op", id: int = 1, pid: int = 100, message: str = "", **more) -> dict:
    return {
        "eventType": "signpostEvent", "signpostType": kind, "signpostName": name, "signpostID": id, "pid": pid,
        "timestamp": at(seconds), "message": message, **more,
    }
