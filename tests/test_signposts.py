import random

import pytest
from rows import at, event, log_frame

from emberlog.operators import ordered
from emberlog.operators import signposts as s
from emberlog.operators.filters import FilterSpec
from emberlog.plans.signpost_report import signpost_report


def intervals(spark, *events):
    return s.signpost_intervals(log_frame(spark, list(events)))


def totals(spark, *events):
    r = s.signpost_totals(log_frame(spark, list(events))).head()
    return r["count"], r.in_flight, r.orphan_ends, r.overwritten


def test_one_interval(spark):
    found = intervals(spark, event("begin", 0, message="len 5", subsystem="com.a"), event("end", 0.045)).collect()
    assert [(r.duration_ms, r.message, r.subsystem, r.end) for r in found] == [(45.0, "len 5", "com.a", at(0.045))]


def test_overlapping_ids(spark):
    found = intervals(
        spark, event("begin", 0, id=1, message="a"), event("begin", 0.002, id=2, message="b"),
        event("end", 0.013, id=1), event("end", 0.020, id=2),
    )
    assert sorted((r.message, r.duration_ms) for r in found.collect()) == [("a", 13.0), ("b", 18.0)]


def test_processes_do_not_mix(spark):
    assert totals(spark, event("begin", 0, pid=100), event("end", 1, pid=200)) == (1, 1, 1, 0)


def test_unpaired(spark):
    assert totals(spark, event("begin", 0)) == (1, 1, 0, 0)
    assert totals(spark, event("end", 0)) == (0, 0, 1, 0)
    assert totals(spark, event("event", 0)) == (0, 0, 0, 0)
    assert totals(spark, {"message": "plain"}) == (0, 0, 0, 0)
    assert totals(spark, event("begin", 0, name=None), event("begin", 0, id=None), event(None, 0)) == (0, 0, 0, 0)
    assert totals(spark) == (0, 0, 0, 0)


def test_arrival_order_decides(spark):
    assert totals(spark, event("end", 1), event("begin", 0)) == (1, 1, 1, 0)
    assert totals(spark, event("begin", 0), event("begin", 1), event("end", 3)) == (1, 0, 0, 1)
    found = intervals(spark, event("begin", 0), event("begin", 1), event("end", 3)).collect()
    assert [r.duration_ms for r in found] == [2000.0]
    backwards = intervals(spark, event("begin", 3), event("end", 1)).collect()
    assert [r.duration_ms for r in backwards] == [-2000.0]


def test_ids_beyond_int64(spark):
    from decimal import Decimal

    big = Decimal("17216892719917625070")
    assert totals(spark, event("begin", 0, id=big), event("end", 1, id=big), event("end", 2, id=big - 1)) == (1, 0, 1, 0)


def pairs(name, *lengths, id0=0):
    rows = []
    for i, ms in enumerate(lengths):
        rows.append(event("begin", i, name=name, id=id0 + i))
        if ms is not None:
            rows.append(event("end", i + ms / 1000, name=name, id=id0 + i))
    return rows


def test_summary(spark):
    found = s.signpost_summary(intervals(spark, *pairs("op", 40, 42, 50), *pairs("half", 20, None), *pairs("open", None))).collect()
    by_name = {r.name: r for r in found}
    op = by_name["op"]
    assert (op["count"], op.in_flight, op.min_ms, op.p50_ms, op.max_ms, op.total_ms) == (3, 0, 40.0, 42.0, 50.0, 132.0)
    half = by_name["half"]
    assert (half["count"], half.in_flight, half.total_ms, half.p50_ms) == (2, 1, 20.0, 20.0)
    assert (by_name["open"]["count"], by_name["open"].p50_ms, by_name["open"].total_ms) == (1, None, None)


def test_order_of_summaries(spark):
    rows = [*pairs("fast", 10), *pairs("slow", 100), *pairs("a", None), *pairs("b", None), *pairs("same", 10)]
    ranked = s.summaries_by_total(s.signpost_summary(intervals(spark, *rows))).collect()
    assert [r.name for r in ranked] == ["slow", "same", "fast", "b", "a"]
    table = s.signpost_table(log_frame(spark, rows)).collect()
    assert tuple(table[0]) == ("slow", 1, "100ms", "100ms", "100ms", "-")
    assert tuple(table[3])[2:] == ("-", "-", "-", "-")


def test_occurrences_and_last_arguments(spark):
    found = intervals(spark, event("begin", 5, id=1, message="late"), event("begin", 1, id=2, message="early"))
    flat = s.signpost_occurrences(found).collect()
    assert [(r.message, r.duration_ms) for r in flat] == [("early", None), ("late", None)]
    assert [r.message for r in s.intervals_by_start(found).collect()] == ["early", "late"]
    assert [r.last_args for r in s.last_args(found).collect()] == ["late"]


def test_footer(spark):
    def unpaired(*events):
        return tuple(s.signpost_footer(log_frame(spark, list(events))).head())

    assert unpaired(event("begin", 0), event("end", 1)) == (0, 0)
    assert unpaired(event("end", 1)) == (0, 1)
    assert unpaired(event("begin", 0, id=2), event("end", 1), event("end", 1)) == (1, 2)


def test_report(spark):
    logs = log_frame(spark, [event("begin", 0, subsystem="com.a"), event("end", 1, subsystem="com.a"), event("begin", 0, id=9, subsystem="com.b")])
    report = signpost_report(logs, FilterSpec(subsystem="com.a", level="fault"), full=True)
    told = dict(count=1, in_flight=0, orphan_ends=0, overwritten=0, mode="show", hint_code=None, hint=None)
    assert report.header.head().asDict() == told
    assert report.intervals.count() == 1 and report.occurrences.count() == 1
    none = signpost_report(logs, FilterSpec(pid=-1))
    assert none.occurrences is None
    header = none.header.head()
    assert header["count"] == 0 and header.hint_code and header.hint


def simulate(rows):
    pending, done, orphans, replaced = {}, [], 0, 0
    for seq, row in enumerate(rows):
        key = (row["pid"], row["signpostName"], row["signpostID"])
        if row["signpostType"] == "begin":
            replaced += key in pending
            pending[key] = seq
        elif row["signpostType"] == "end":
            if key in pending:
                done.append((pending.pop(key), seq))
            else:
                orphans += 1
    return done, sorted(pending.values()), orphans, replaced


@pytest.mark.parametrize("ranges, hot_rows", [(1, 1), (9, 1), (50, 20), (4, 100), (8, 1 << 16), (8, None)])
def test_pairing_equals_a_state_machine(spark, monkeypatch, ranges, hot_rows):
    """A third and more of the events share one key, which many ranges have to share."""
    monkeypatch.setattr(ordered.with_neighbours, "__defaults__", (*ordered.with_neighbours.__defaults__[:-2], ranges, hot_rows))
    chance = random.Random(11)
    rows = []
    for i in range(500):
        hot = chance.random() < 0.4
        rows.append(
            event(chance.choice(["begin", "end", "end", "begin", "event"]), i * 1.5, name="op",
                  id=0 if hot else chance.randrange(12), pid=100 if hot else chance.randrange(3))
        )
    done, open_, orphans, replaced = simulate(rows)
    assert totals(spark, *rows) == (len(done) + len(open_), len(open_), orphans, replaced)
    found = intervals(spark, *rows).collect()
    assert sorted((r.begin_seq, r.end) for r in found if r.end) == sorted((b, at(e * 1.5)) for b, e in done)
    assert sorted(r.begin_seq for r in found if not r.end) == open_


def test_median_of_many(spark):
    chance = random.Random(2)
    rows = [(k, chance.choice([chance.randrange(-50, 50), chance.randrange(-(1 << 45), 1 << 45), 7])) for k in "ab" for _ in range(301 if k == "a" else 200)]
    rows += [("c", None), ("d", -3)]
    found = {r.k: (r.low, r.high) for r in s.p50(spark.createDataFrame(rows, "k string, v long"), "v", ("k",)).collect()}
    for key in "ab":
        values = sorted(v for k, v in rows if k == key)
        assert found[key] == (values[(len(values) - 1) // 2], values[len(values) // 2])
    assert found["d"] == (-3, -3) and "c" not in found
    overall = s.p50(spark.createDataFrame(rows, "k string, v long"), "v").head()
    values = sorted(v for _, v in rows if v is not None)
    assert tuple(overall) == (values[(len(values) - 1) // 2], values[len(values) // 2])
