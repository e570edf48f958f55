"""Plans keep their shape: how often the input is read, what is shuffled, and no all-pairs joins.

Executed plans are walked with their scalar subqueries; see `executed.py`.
"""

import pytest
from executed import executed, scans, shuffled_rows
from rows import SF_DIR, event, log_frame

import __spark_entry__ as entry
from emberlog.operators.ordered import with_neighbours

# Reads of the input, those of a single column for quantiles or frequent keys included.
SCANS = {
    "scan_filter": 1,
    "profile_match": 1,
    "coverage_matrix": 1,
    "result_summary": 1,
    "pairing_state": 3,
    "signpost_totals": 3,
    "signpost_summary": 3,
    "signpost_table": 3,
    "dedup_consecutive": 2,
    "relative_time": 2,
    "p50": 1,
    "limit_n": 3,
    "head_tail": 3,
    "result_envelope_plain": 1,
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans(spark, name):
    found = executed(entry.queries()[name](spark, SF_DIR))
    names = {kind for kind, _ in found}
    assert scans(found) <= SCANS[name]
    assert not any(part in kind for kind in names for part in ("NestedLoop", "Cartesian", "Python"))


def test_a_hot_name_is_counted_before_the_shuffle(spark):
    found = executed(entry.queries()["distinct_first"](spark, SF_DIR))
    assert sum(kind == "WindowGroupLimitExec" for kind, _ in found) == 2


def test_ids_used_once_are_shuffled_once(spark):
    """Every event goes through one exchange, as with one window on the key; the rest is a row per sketch."""
    df = entry.queries()["pairing_state_single_use"](spark, SF_DIR)
    moved = shuffled_rows(executed(df))
    assert moved[0] == df.count() and sum(moved[1:]) <= 8


def test_one_pairing_per_answer(spark):
    """One exchange of the events, one of the histogram; all else is small."""
    df = entry.queries()["signpost_summary_single_use"](spark, SF_DIR)
    found = executed(df)
    events = entry.queries()["pairing_state_single_use"](spark, SF_DIR).count()
    moved = shuffled_rows(found)
    assert moved[0] == events and moved[1] <= events // 2 and sum(moved) < 2.5 * events


def test_a_hot_key_spreads(spark):
    """Of a key with most of the events, no range has twice its share, and few rows go on."""
    rows = [event("begin" if i % 2 else "end", i, id=1 if i % 10 else i) for i in range(8000)]
    logs = log_frame(spark, rows)
    found = executed(with_neighbours(logs.select("seq", "signpostID"), {"b": "seq"}, {"a": "seq"}, ("signpostID",), ranges=16, hot_rows=2000))
    moved = shuffled_rows(found)
    assert moved[:2] == [8000, 7200] and sum(moved[2:]) <= 2 * 16 + 2 * 8
