"""Streams give what the batch operators give, whatever the batches and however often they run."""

import json
import random
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from rows import event, log_frame

from emberlog.catalog import sources
from emberlog.catalog.tables import event_logs
from emberlog.operators.filters import FilterSpec, scan_filter
from emberlog.operators.ordered import dedup_consecutive
from emberlog.operators.signposts import pairing_events, pairing_state
from emberlog.operators.summary import combination_counts, result_summary, summary_of
from emberlog.plans.signpost_report import report_of
from emberlog.schema import LOG_SCHEMA
from emberlog.streaming.batches import shared_dir
from emberlog.streaming.capture import capture_stream
from emberlog.streaming.dedup import dedup_batch, dedup_result, stream_dedup
from emberlog.streaming import versions
from emberlog.streaming.signposts import capture_signposts, signposts_batch, signposts_result, stream_signposts
from emberlog.streaming.summary import read_summary, summary_batch, write_summary
from emberlog.streaming.tail import bad_lines, stream_lines, stream_table, stream_tail, tailed_bad, tailed_rows, write_lines

NOW = {"availableNow": True}


@pytest.fixture(scope="module")
def logs(spark):
    chance = random.Random(1)
    rows = []
    for i in range(120):
        row = event(chance.choice(["begin", "end", "event"]), i, id=chance.randrange(5), name=chance.choice("ab"))
        rows.append({**row, "message": chance.choice("xxxy"), "level": chance.choice(["Error", "Info"]), "subsystem": "com.a"})
    return log_frame(spark, rows).cache()


@pytest.fixture(scope="module")
def landed(spark, logs, tmp_path_factory):
    """The rows as files that arrive one after the other."""
    path = str(tmp_path_factory.mktemp("landed"))
    for i in range(4):
        logs.where(f"seq >= {i * 30} and seq < {i * 30 + 30}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def live(spark, path):
    return stream_table(spark, path, LOG_SCHEMA, maxFilesPerTrigger=1)


def same(a, b):
    columns = sorted(a.columns)
    key = [sorted(map(repr, frame.select(columns).collect())) for frame in (a, b)]
    assert key[0] == key[1]


def test_dedup(spark, logs, landed):
    path = shared_dir(spark, "dedup")
    stream_dedup(live(spark, landed), path, f"{path}-cp", **NOW).awaitTermination()
    assert spark.read.parquet(path).select("batch_id").distinct().count() == 4
    found = dedup_result(spark, path)
    same(found.drop("head_batch"), dedup_consecutive(logs).drop("text"))
    unflushed = dedup_result(spark, path, flush=False)
    assert unflushed.count() == found.count() - 1


def test_signposts(spark, logs, landed):
    path = shared_dir(spark, "signposts")
    stream_signposts(live(spark, landed), path, f"{path}-cp", **NOW).awaitTermination()
    same(signposts_result(spark, path), pairing_state(logs))


@pytest.mark.parametrize("cuts", [(0, 120), (0, 1, 60, 60, 120), (0, 0, 119, 120)])
def test_batches_may_run_again(spark, logs, cuts):
    """Empty batches, single rows, and every batch done twice."""
    pairs, runs = shared_dir(spark, "pairs"), shared_dir(spark, "runs")
    for batch_id, (low, high) in enumerate(zip(cuts, cuts[1:])):
        batch = logs.where(f"seq >= {low} and seq < {high}")
        for _ in range(2):
            signposts_batch(batch, batch_id, pairs)
            dedup_batch(batch, batch_id, runs)
    same(signposts_result(spark, pairs), pairing_state(logs))
    same(dedup_result(spark, runs).drop("head_batch"), dedup_consecutive(logs).drop("text"))


def test_summary(spark, logs, landed):
    path = shared_dir(spark, "summary")
    write_summary(live(spark, landed), path, f"{path}-cp", **NOW).awaitTermination()
    assert summary_of(read_summary(spark, path)).head() == result_summary(logs).head()


def cut(logs, size):
    n = logs.count()
    return [logs.where(f"seq >= {low} and seq < {low + size}") for low in range(0, n, size)]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("work, result, whole", [
    (signposts_batch, signposts_result, pairing_state),
    (lambda batch, i, path: summary_batch(batch, i, path, merged_after=2), read_summary, combination_counts),
])
def test_a_batch_that_fails_loses_nothing(spark, logs, monkeypatch, work, result, whole):
    """Every write of every batch fails once, just before and just after it; readers see whole batches only."""
    path, batches, done = shared_dir(spark, "failing"), cut(logs, 40), 0
    with pytest.raises(LookupError):
        result(spark, path)
    publish, write, count = versions.publish, DataFrameWriter.parquet, [0]

    for batch_id, batch in enumerate(batches):
        for fail_at in range(1, 7):
            count[0] = 0

            def failing(real):
                def call(*args, **options):
                    count[0] += 1
                    if count[0] == fail_at:
                        raise Stopped
                    real(*args, **options)
                    count[0] += 1
                    if count[0] == fail_at:
                        raise Stopped

                return call

            with monkeypatch.context() as patched:
                patched.setattr(versions, "publish", failing(publish))
                patched.setattr(DataFrameWriter, "parquet", failing(write))
                try:
                    work(batch, batch_id, path)
                except Stopped:
                    pass
            seen = versions.latest(spark, path)
            done = -1 if seen is None else seen.batch_id
            assert done in (batch_id - 1, batch_id)
            if fail_at in (2, 4) and done >= 0:
                same(result(spark, path), whole(logs.where(f"seq < {40 * (done + 1)}")))
        work(batch, batch_id, path)
        assert versions.latest(spark, path).batch_id == batch_id
    same(result(spark, path), whole(logs))


def stored_rows(spark, path):
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return files.count()


def test_lone_begins_are_kept_twice_at_most(spark):
    """Fifty batches of begins that never end: what is stored stays within two generations."""
    path = shared_dir(spark, "lone")
    rows = log_frame(spark, [event("begin", i, id=i) for i in range(200)]).cache()
    for i in range(50):
        signposts_batch(rows.where(f"seq >= {4 * i} and seq < {4 * i + 4}"), i, path)
        if i % 10 == 9:
            assert stored_rows(spark, path) <= 2 * 4 * (i + 1)
    assert stored_rows(spark, path) == 200 + 196
    same(signposts_result(spark, path), pairing_state(rows))
    assert len(versions._ids(spark, path)) == 2


def test_old_begins_are_given_up(spark):
    rows = log_frame(spark, [
        event("begin", 0, id=1), event("begin", 90, id=2), event("end", 100, id=2), event("begin", 200, id=3),
        event("end", 210, id=1), event("end", 215, id=3),
    ])
    path = shared_dir(spark, "ttl")
    for i in range(6):
        signposts_batch(rows.where(f"seq = {i}"), i, path, ttl="1m")
    states = {r.seq: r.state for r in signposts_result(spark, path).collect()}
    assert states == {0: "in_flight", 1: "completed", 2: "completed", 3: "completed", 4: "orphan", 5: "completed"}
    assert pairing_state(rows).where("state = 'orphan'").count() == 0


def test_capture_of_intervals(spark, logs, landed):
    path = shared_dir(spark, "intervals")
    answer = capture_signposts(live(spark, landed), path, f"{path}-cp", FilterSpec(subsystem="com.a"), 600, most=50, **NOW)
    events = pairing_events(logs).orderBy("seq").limit(50)
    assert (answer.stop_reason, answer.events) == ("count", 50)
    expected = report_of(pairing_state(events), mode="stream")
    same(answer.report.header, expected.header)
    same(answer.report.intervals, expected.intervals)
    again = capture_signposts(live(spark, landed), path, f"{path}-cp", FilterSpec(subsystem="com.a"), 600, most=50, **NOW)
    assert again[:2] == answer[:2]
    more = capture_signposts(live(spark, landed), path, f"{path}-cp", FilterSpec(subsystem="com.a"), 600, **NOW)
    assert more.stop_reason == "exhausted" and more.events >= 50


def test_capture_of_intervals_goes_on_with_its_clock(spark, logs, landed):
    """A capture that is run again counts its time from when it began, and a whole one equals the batch answer."""
    path = shared_dir(spark, "intervals")
    answer = capture_signposts(live(spark, landed), path, f"{path}-cp", seconds=600, full=True, **NOW)
    assert answer.stop_reason == "exhausted" and answer.events == pairing_events(logs).count()
    same(answer.report.intervals, report_of(pairing_state(logs)).intervals)
    began = versions.latest(spark, path).note["began"]
    time.sleep(1)
    late = capture_signposts(live(spark, landed), path, f"{path}-cp", seconds=0.5)
    assert (late.stop_reason, late.events) == ("time", answer.events) and versions.latest(spark, path).note["began"] == began
    path = shared_dir(spark, "intervals")
    none = capture_signposts(live(spark, landed).where("pid < 0"), path, f"{path}-cp", seconds=600, **NOW)
    assert none.stop_reason == "exhausted" and none.events == 0 and none.report.header.head().hint_code == "nothing_paired"


def test_lines_keep_their_order_and_bad_ones_are_told(spark, tmp_path):
    """Several files, several batches, and a restart in between; numbers rise along files and lines."""
    source, path = tmp_path / "in", shared_dir(spark, "lines")
    source.mkdir()

    def land(name, *messages):
        made = [m if m.startswith(("bad", " ")) else json.dumps({"timestamp": "2024-01-15T10:30:45Z", "eventMessage": m}) for m in messages]
        (source / name).write_text("\n".join(made) + "\n")
        time.sleep(0.05)

    def follow():
        write_lines(spark, str(source), path, f"{path}-cp", {"maxFilesPerTrigger": 1}, **NOW).awaitTermination()

    land("b.txt", "one", "bad 1", "two", " ")
    land("a.txt", "three", "four")
    follow()
    land("c.txt", "bad 2", "five")
    land("0.txt", "six")
    follow()
    told = sorted((r.seq, r.message) for r in tailed_rows(spark, path).collect())
    assert [m for _, m in told] == ["one", "two", "three", "four", "five", "six"]
    assert [s for s, _ in told] == [0, 2, 4, 5, 7, 8]
    assert sorted(map(tuple, tailed_bad(spark, path).collect())) == [(1, "bad 1"), (6, "bad 2")]
    query = bad_lines(spark, str(source)).writeStream.option("checkpointLocation", f"{path}-bad-cp").trigger(**NOW)
    query.format("parquet").start(f"{path}-bad").awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(f"{path}-bad").collect()) == ["bad 1", "bad 2"]


def test_tail_of_text(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = {"timestamp": "2024-01-15T10:30:45Z", "subsystem": "com.a", "eventMessage": "hello"}
    (source / "1.txt").write_text(json.dumps(line) + "\ngarbage\n\n")
    (source / "2.txt").write_text("2024-01-15 10:30:46.5+0000 P[1] (com.a) [Error] old hello\n" + json.dumps({**line, "subsystem": "b"}))
    path = shared_dir(spark, "tail")
    rows = stream_tail(stream_lines(spark, str(source)), FilterSpec(subsystem="com.a"))
    query = rows.writeStream.option("checkpointLocation", f"{path}-cp").trigger(**NOW).format("parquet").start(path)
    query.awaitTermination()
    assert sorted(r.message for r in spark.read.parquet(path).collect()) == ["hello", "old hello"]
    runs = shared_dir(spark, "text")
    stream_dedup(rows, runs, f"{runs}-cp", **NOW).awaitTermination()
    assert sorted(r.message for r in dedup_result(spark, runs).collect()) == ["hello", "old hello"]


def test_capture_by_count(spark, logs, landed):
    path = shared_dir(spark, "capture")
    rows = stream_tail(live(spark, landed), FilterSpec(level="error", signpost=True))
    answer = capture_stream(rows, path, f"{path}-cp", count=40, timeout="60s", **NOW)
    expected = sorted(r.seq for r in scan_filter(logs, FilterSpec(level="error", signpost=True)).collect())[:40]
    assert answer == ("count", 40)
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == expected


def test_capture_run_again_counts_what_it_has(spark, landed):
    path = shared_dir(spark, "capture")
    first = capture_stream(live(spark, landed), path, f"{path}-cp", count=25, timeout="60s", **NOW)
    assert first == ("count", 25)
    again = capture_stream(live(spark, landed), path, f"{path}-cp", count=60, timeout="60s", **NOW)
    assert spark.read.parquet(path).count() == again.captured <= 60


def test_capture_ends(spark, landed):
    path = shared_dir(spark, "capture")
    answer = capture_stream(live(spark, landed), path, f"{path}-cp", **NOW)
    assert answer == ("exhausted", 120)
    path = shared_dir(spark, "capture")
    nothing = stream_tail(live(spark, landed), FilterSpec(pid=-1))
    assert capture_stream(nothing, path, f"{path}-cp", timeout="2s") == ("timeout", 0)
    path = shared_dir(spark, "capture")
    started = time.monotonic()
    answer = capture_stream(live(spark, landed), path, f"{path}-cp", capture="6s", timeout="60s")
    assert answer.stop_reason == "capture" and answer.captured > 0 and time.monotonic() - started < 60


def test_landing_in_several_files(spark, tmp_path, monkeypatch):
    """A part lands in equally many files, a batch each, or in one file where a part could not be cut like that."""
    rows = [(i, f"2024-01-01 00:00:{i % 60:02}", i % 7, ["click", "view"][i // 3 % 2], 1.0, f'{{"k": {i % 5}}}') for i in range(240)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, kept, files in (("even", events, 4), ("uneven", events.where("event_id >= 40 or event_id = 5"), 1)):
        sf_dir = f"{tmp_path}/{name}"
        kept.write.parquet(f"{sf_dir}/events.parquet")
        landed, seen = f"{tmp_path}/{name}-runs", []
        monkeypatch.setattr(sources, "shared_dir", lambda spark, _, name=name: f"{tmp_path}/{name}-landed")
        live = sources._landing(spark, sf_dir, 10)
        live.writeStream.option("checkpointLocation", f"{landed}-seen").trigger(**NOW).foreachBatch(
            lambda batch, _: seen.append(sorted(r.seq for r in batch.select("seq").collect()))
        ).start().awaitTermination()
        assert len(list((tmp_path / f"{name}-landed").glob("*.parquet"))) == 6 * files
        assert len(seen) == 6 and sum(seen, []) == sorted(r.event_id for r in kept.collect())
        stream_dedup(live, landed, f"{landed}-cp", **NOW).awaitTermination()
        same(dedup_result(spark, landed).drop("head_batch"), dedup_consecutive(event_logs(spark, sf_dir)).drop("text"))
