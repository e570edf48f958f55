import pytest
from executed import executed, scans
from rows import SF_DIR, at, log_frame

from emberlog.catalog.tables import as_logs
from emberlog.operators.coverage import coverage_matrix, redaction_check
from emberlog.operators.filters import FilterSpec
from emberlog.operators.inventory import distinct_first, process_inventory
from emberlog.operators.limits import head_tail, last_n, limit_n, list_head_tail, next_since, scan_ceiling, tail_cursor
from emberlog.operators.summary import combination_counts, dimension_counts, result_summary, summary_of
from emberlog.plans.capture import bounded_capture, capture_report, capture_status
from emberlog.plans.envelope import result_envelope, retained_rows, written_envelope
from emberlog.sources.store import replay_spill


def many(spark, n, **columns):
    return log_frame(spark, [{"message": f"m{i}", "timestamp": at(i), **columns} for i in range(n)])


def numbers(rows):
    return None if rows is None else [r.seq for r in rows]


def test_small_results_are_inlined(spark):
    answer = result_envelope(many(spark, 10), threshold=50, k=10).head()
    assert (answer["count"], answer.truncated, answer.scan_capped) == (10, False, False)
    assert numbers(answer.entries) == list(range(10)) and answer.head is None and answer.tail is None


@pytest.mark.parametrize("n, inline", [(50, True), (51, False)])
def test_threshold(spark, n, inline):
    answer = result_envelope(many(spark, n), threshold=50, k=10).head()
    assert answer.truncated is not inline and (answer.entries is not None) is inline


def test_large_results_are_sampled(spark):
    logs = many(spark, 200)
    answer = result_envelope(logs, threshold=50, k=10).head()
    assert answer.truncated and answer.entries is None
    assert numbers(answer.head) == list(range(10)) and numbers(answer.tail) == list(range(190, 200))
    full = result_envelope(logs, full=True, limit=200).head()
    assert numbers(full.entries) == list(range(200)) and not full.truncated
    part = result_envelope(logs, full=True, limit=120).head()
    assert numbers(part.entries) == list(range(120)) and part.truncated
    assert retained_rows(logs, 150).count() == 150 and retained_rows(logs).count() == 200


def test_nothing_is_cut_by_default(spark):
    logs = log_frame(spark, [{"level": f"L{i % 30}", "timestamp": at(i)} for i in range(1200)])
    answer = result_envelope(logs).head()
    assert (answer["count"], answer.scan_capped, answer.truncated) == (1200, False, True)
    assert len(answer.summary.by_level) == 30 and sum(answer.summary.by_level.values()) == 1200
    assert capture_report(logs, timeout=10_000).head().captured == capture_report(logs, timeout=10_000, count=5000).head().captured


def test_limit_and_ceiling(spark):
    answer = result_envelope(many(spark, 200), limit=60, ceiling=120, threshold=50, k=10).head()
    assert (answer["count"], answer.scan_capped) == (120, True)
    assert numbers(answer.tail) == list(range(50, 60))
    assert answer.summary.time_range.end == at(119)
    assert answer.next_since == at(119.000001)
    exact = result_envelope(many(spark, 20), ceiling=20).head()
    assert exact.scan_capped
    only = result_envelope(many(spark, 200), summary_only=True)
    assert "entries" not in only.columns and only.head()["count"] == 200


def test_parameters_are_checked(spark):
    logs = many(spark, 1)
    with pytest.raises(ValueError, match="mutually exclusive"):
        result_envelope(logs, full=True, summary_only=True)
    with pytest.raises(ValueError, match="retained_rows"):
        result_envelope(logs, full=True)
    with pytest.raises(ValueError, match="limit"):
        limit_n(logs, 0)
    with pytest.raises(ValueError, match="count"):
        capture_report(logs, count=0)


def test_empty_result(spark):
    empty = many(spark, 5).where("pid < 0")
    answer = result_envelope(empty, threshold=50, k=10, spec=FilterSpec(subsystem="com.a")).head()
    assert (answer["count"], answer.summary, answer.next_since, answer.entries) == (0, None, None, [])
    assert answer.hint_code == "not_persisted" and answer.hint
    assert result_envelope(empty, spec=FilterSpec(process="x", level="error")).head().hint_code == "process_only"
    assert result_envelope(empty, spec=FilterSpec(subsystem="x", level="error")).head().hint is None
    assert result_envelope(empty, last="1m").head().hint_code == "short_range"
    assert result_envelope(empty, last="5m").head().hint is None
    summary = result_summary(empty).head()
    assert (summary["count"], summary.time_range, summary.by_level, summary.top_processes) == (0, None, {}, [])


def test_summary(spark):
    logs = log_frame(
        spark,
        [
            {"processName": "A", "level": "Error", "subsystem": "x", "timestamp": at(5), "category": ""},
            {"processName": "A", "level": "Error", "subsystem": "x", "timestamp": at(1), "category": "c"},
            {"processName": "B", "level": "Default", "subsystem": "y", "timestamp": at(9)},
            {"processName": "A", "level": "Info", "timestamp": at(3)},
        ],
    )
    found = result_summary(logs).head()
    assert found.by_level == {"Error": 2, "Default": 1, "Info": 1}
    assert [tuple(b) for b in found.top_processes] == [("A", 3), ("B", 1)]
    assert [tuple(b) for b in found.top_subsystems] == [("x", 2), ("y", 1)]
    assert [tuple(b) for b in found.top_categories] == [("c", 1)]
    # The first and the last to arrive, not the earliest and latest.
    assert tuple(found.time_range) == (at(5), at(3))
    assert summary_of(combination_counts(logs)).head() == found
    assert dimension_counts(combination_counts(logs)).where("dimension = 'level'").count() == 3
    assert [tuple(b) for b in result_summary(logs, n=1).head().top_subsystems] == [("x", 2)]


def test_head_tail(spark):
    found = {r.seq: r.position for r in head_tail(many(spark, 30), threshold=20, k=5).collect()}
    assert found == {**{i: "head" for i in range(5)}, **{i: "tail" for i in range(25, 30)}}
    overlapping = {r.seq: r.position for r in head_tail(many(spark, 12), threshold=5, k=10).collect()}
    assert overlapping == {**{i: "head" for i in range(10)}, 10: "tail", 11: "tail"}
    assert {r.position for r in head_tail(many(spark, 12), 50, 10).collect()} == {"inline"}
    assert head_tail(many(spark, 80), 50, 10, full=True).where("position = 'inline' and not truncated").count() == 80
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(60)], "name string")
    ends = list_head_tail(names, ["name"], 50, 10)
    assert sorted(r.name for r in ends.where("position = 'tail'").collect()) == [f"n{i:03}" for i in range(50, 60)]
    assert ends.count() == 20 and list_head_tail(names, ["name"], 50, 10, full=True).count() == 60


def test_limits(spark):
    logs = many(spark, 30)
    assert sorted(numbers(limit_n(logs, 7).collect())) == list(range(7))
    assert sorted(numbers(last_n(logs, 4).collect())) == [26, 27, 28, 29]
    assert limit_n(logs, 100).count() == 30
    assert {r.scan_capped for r in scan_ceiling(logs, 30).collect()} == {True}
    assert {r.scan_capped for r in scan_ceiling(logs, 31).collect()} == {False}


def test_cursor(spark):
    logs = many(spark, 5)
    since = next_since(logs).head()[0]
    assert since == at(4.000001) and tail_cursor(logs, since).count() == 0
    assert tail_cursor(logs, at(3)).count() == 2 and tail_cursor(logs).count() == 5
    assert next_since(logs.where("pid < 0")).head()[0] is None


def test_inventory(spark):
    rows = [{"processName": n, "pid": p} for n, p in (("b", 3), ("A", 2), ("b", 1), ("C", 9), ("A", 7))]
    logs = log_frame(spark, rows)
    assert [tuple(r) for r in process_inventory(logs).collect()] == [("A", 2), ("b", 3), ("C", 9)]
    assert [tuple(r) for r in process_inventory(logs, "B").collect()] == [("b", 3)]
    assert sorted(numbers(distinct_first(logs, "processName").collect())) == [0, 1, 3]


def test_capture(spark):
    logs = many(spark, 20)

    def taken(**bounds):
        rows = bounded_capture(logs, **bounds).collect()
        status = capture_status(logs, **bounds).head()
        assert status.captured == len(rows) and {r.stop_reason for r in rows} <= {status.stop_reason}
        return len(rows), status.stop_reason

    assert taken() == (20, "exhausted")
    assert taken(count=5) == (5, "count")
    assert taken(count=20) == (20, "count")
    assert taken(count=21) == (20, "exhausted")
    assert taken(capture="3s") == (4, "capture")
    assert taken(capture="1h") == (20, "exhausted")
    assert taken(capture="3s", count=4) == (4, "count")
    assert taken(timeout="2s", started=at(-1)) == (20, "exhausted")
    assert taken(timeout="2s", started=at(-3)) == (0, "timeout")
    none = capture_status(logs.where("pid < 0"), timeout=1, started=at(0)).head()
    assert tuple(none) == (0, "timeout")
    with pytest.raises(ValueError, match="started"):
        bounded_capture(logs, timeout=1)
    with pytest.raises(ValueError, match="count"):
        bounded_capture(logs, count=0)


def test_capture_report(spark):
    logs = many(spark, 120, subsystem="com.a")
    by_count = capture_report(logs, count=60, timeout=100, threshold=50, k=10).head()
    assert (by_count.captured, by_count.requested, by_count.stopped_by, by_count.truncated) == (60, 60, "count", True)
    assert numbers(by_count.tail) == list(range(50, 60))
    by_time = capture_report(logs, timeout=30, threshold=50, k=10).head()
    assert (by_time.captured, by_time.requested, by_time.stopped_by) == (31, None, "timeout")
    assert numbers(by_time.entries) == list(range(31))
    assert capture_report(logs, timeout=1000).head().stopped_by == "exhausted"
    nothing = capture_report(logs, FilterSpec(pid=-1), timeout=1000, threshold=50, k=10).head()
    assert (nothing.captured, nothing.summary, nothing.entries) == (0, None, [])


def test_coverage(spark):
    lines = spark.createDataFrame(
        [("stdout", "SMOKE|n|print ok"), ("stdout", "other"), ("show", "SMOKE|n|fault x"), ("show", "SMOKE|n|private SECRET-n"),
         ("show", "SMOKE|n|private <private>"), ("other", "SMOKE|n|print")],
        "source string, text string",
    )
    markers = {name: f"SMOKE|n|{name}" for name in ("print", "fault", "private")}
    grid = {r.marker: (r.stdout, r.show, r.stderr) for r in coverage_matrix(lines, markers, ["stdout", "show", "stderr"]).collect()}
    assert grid == {"print": ("YES", "no", "no"), "fault": ("no", "YES", "no"), "private": ("no", "YES", "no")}
    none = coverage_matrix(lines.where("false"), markers, ["show"]).collect()
    assert sorted((r.marker, r.show) for r in none) == [("fault", "no"), ("print", "no"), ("private", "no")]
    checks = {(r.source, r.marker): (r.present, r.leaked) for r in redaction_check(lines, markers, "SECRET-n").collect()}
    assert checks[("show", "private")] == (True, True)
    assert checks[("show", "fault")] == (True, False)
    assert checks[("stdout", "private")] == (False, False)


def test_an_answer_with_its_rest_written_out(spark, tmp_path):
    """A file exactly when the answer does not show all rows; it holds them all and can be replayed."""
    path = str(tmp_path / "rest")
    small = written_envelope(many(spark, 20), path, threshold=20, k=3).head()
    assert small.output_file is None and len(small.entries) == 20 and not (tmp_path / "rest").exists()
    logs = many(spark, 200, subsystem="com.a")
    answer = written_envelope(logs, path, threshold=20, k=3, limit=150)
    told = answer.head()
    assert told.output_file == path and numbers(told.head) == [0, 1, 2] and numbers(told.tail) == [147, 148, 149]
    assert answer.drop("output_file").head() == result_envelope(logs, limit=150, threshold=20, k=3).head()
    assert [r.message for r in replay_spill(spark, path).orderBy("seq").collect()] == [f"m{i}" for i in range(150)]
    capped = written_envelope(logs, path, threshold=20, k=3, ceiling=40).head()
    assert (capped["count"], capped.scan_capped, replay_spill(spark, path).count()) == (40, True, 40)


def test_captures_read_their_state_once(spark):
    """One state of the input for all that is asked of it, subqueries counted."""
    path = f"{SF_DIR}/events.parquet"
    logs = as_logs(spark.read.parquet(path))
    assert scans(executed(bounded_capture(logs, capture="72h"))) == 2
    assert scans(executed(bounded_capture(logs, capture="72h", count=50, timeout="1h", started="2024-01-01"))) <= 5
    assert scans(executed(capture_report(logs, timeout=7200, threshold=20, k=3))) <= 4
