import json
from decimal import Decimal

import pytest
from rows import at, event, log_frame

from emberlog.operators.filters import FilterSpec
from emberlog.operators.signposts import signpost_intervals
from emberlog.sources.ingest import ingest_legacy_text, ingest_mixed, ingest_ndjson
from emberlog.sources.lines import read_lines
from emberlog.sources.store import (
    SpillError,
    replay_spill,
    scan_archive,
    scan_historical,
    source_projection,
    structured_json,
    structured_output,
    write_spill,
)

TIME = '"timestamp":"2024-01-15T10:30:45.123456Z"'
FULL = (
    '{%s,"eventMessage":"brewed two cups","eventType":"logEvent","messageType":"Info","category":"steam",'
    '"subsystem":"org.kettle.boiler","processID":77,"processImagePath":"/opt/kettle/bin/kettled",'
    '"senderImagePath":"/opt/kettle/lib/libvalve.so","source":{"image":"valve","line":9,"file":"valve.c","symbol":"open_valve"}}' % TIME
)


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq long, value string")


def test_full_line(spark):
    row = ingest_ndjson(lines(spark, FULL)).logs.head()
    assert (row.processName, row.pid, row.level, row.message) == ("kettled", 77, "Info", "brewed two cups")
    assert row.source == "valve open_valve valve.c:9"
    assert (row.subsystem, row.category, row.eventType) == ("org.kettle.boiler", "steam", "logEvent")
    assert row.signpostID is None


def test_defaults(spark):
    row = ingest_ndjson(lines(spark, "{%s}" % TIME)).logs.head()
    assert (row.processName, row.pid, row.level, row.message, row.source) == ("unknown", 0, "Default", "", None)
    row = ingest_ndjson(lines(spark, '  {%s,"messageType":"Strange","processImagePath":"/bin/test"}\r' % TIME)).logs.head()
    assert (row.processName, row.level) == ("test", "Default")


def test_blank_lines_are_nothing(spark):
    logs, bad = ingest_mixed(lines(spark, "", "   \n\t  ", "　", None))
    assert (logs.count(), bad.count()) == (0, 0)


def test_spoiled_lines(spark):
    spoiled = [
        "{%s} x", '{%s} {"a":1}', '{%s},"x":{}', '{%s},{"a":1}', '{%s,"pid":1', '{%s,"processID":"1"}', '{%s,"processID":1.5}',
        '{%s,"processID":99999999999999999999}', '{%s,"subsystem":5}', '{%s,"eventMessage":{}}', '{%s,"source":{"file":5}}',
        '{%s,"source":{"line":"x"}}', '{%s,"source":"text"}', '{%s,"signpostID":-1}', '{%s,"signpostID":18446744073709551616}',
        "[{%s}]", '{%s}]} tail', '{%s}]}', '{%s}],"x":[1',
    ]
    texts = [text % TIME for text in spoiled] + ["5", "null", "{}", '{"timestamp":"bad"}', '{"timestamp":null}', '{"timestamp":5}', "text"]
    for reader in (ingest_ndjson, ingest_mixed):
        logs, bad = reader(lines(spark, *texts))
        assert logs.count() == 0
        assert sorted(r.seq for r in bad.collect()) == list(range(len(texts)))
    fine = ['{%s,"subsystem":null}' % TIME, '{%s,"other":{"category":5}}' % TIME, '{%s,"signpostID":18446744073709551615}' % TIME]
    assert ingest_ndjson(lines(spark, *fine)).logs.count() == 3


def test_signpost_lines(spark):
    start = (
        '{"timestamp":"2025-03-04 09:17:08.250640+0200","eventType":"signpostEvent","signpostID":1,"signpostName":"parse",'
        '"signpostType":"Begin","eventMessage":"rows 51 of 70","processID":7}'
    )
    end = start.replace("08.250640", "08.296000").replace("Begin", "end").replace("rows 51 of 70", "")
    big = '{%s,"eventType":"signpostEvent","signpostID":18000000000000000019,"signpostType":"event"}' % TIME
    logs = ingest_ndjson(lines(spark, start, end, big)).logs
    assert logs.where("signpostType = 'event'").head().signpostID == Decimal("18000000000000000019")
    interval = signpost_intervals(logs).head()
    assert (interval.duration_us, interval.duration_ms, interval.message) == (45360, 45.36, "rows 51 of 70")


def test_legacy_lines(spark):
    texts = [
        "2023-07-09 21:05:06.700801-0300  Teapot[77]  (org.example.kettle) [Info]  water is warm",
        "2023-07-09   21:05:06.700801-0300  Teapot[77] [loud]  water is warm  ",
        "2023-07-09 21:05:06.5+0000 Teapot[12]: text (a) [b]",
        "2023-07-09 21:05:06.5+0000 no process [x] here",
        "2023-07-09 21:05:06.5+0000 a[1]b[2] (s)",
        "2023-07-09 21:05:06.5+0000",
        "2023-07-09 21:05:06.5+0000 P[99999999999999999999] m",
        "21:05:06 Teapot[77] nothing",
        "2023-99-09 21:05:06.700801-0300 Teapot[1] m",
    ]
    logs, bad = ingest_legacy_text(lines(spark, *texts))
    found = [(r.processName, r.pid, r.subsystem, r.category, r.level, r.message) for r in logs.orderBy("seq").collect()]
    assert found == [
        ("Teapot", 77, "org.example.kettle", None, "Info", "water is warm"),
        ("Teapot", 77, None, None, "Default", "water is warm"),
        ("Teapot", 12, None, None, "Default", ": text (a) [b]"),
        ("unknown", 0, None, None, "Default", "no process [x] here"),
        ("a[1]b", 2, "s", None, "Default", ""),
        ("unknown", 0, None, None, "Default", ""),
        ("unknown", 0, None, None, "Default", "P[99999999999999999999] m"),
    ]
    assert logs.where("seq = 0").selectExpr("cast(cast(timestamp as timestamp_ntz) as string)").head()[0] == "2023-07-10 00:05:06.700801"
    assert sorted(r.seq for r in bad.collect()) == [7, 8]


def test_mixed_lines(spark):
    legacy = "2023-07-09 21:05:06.700801-0300  Teapot[77]  water is warm"
    logs, bad = ingest_mixed(lines(spark, FULL, legacy, "neither"))
    assert [(r.seq, r.message) for r in logs.orderBy("seq").collect()] == [(0, "brewed two cups"), (1, "water is warm")]
    assert [r.value for r in bad.collect()] == ["neither"]


def test_lines_keep_file_order(spark, tmp_path):
    """Splits of a few bytes, files of different sizes, and still the order of names and lines."""
    texts = {}
    for name, n in (("a.txt", 7), ("b.txt", 400), ("c.txt", 0), ("d.txt", 60)):
        texts[name] = [f"{name}-{i}" + "x" * (i % 13) if i % 5 else "" for i in range(n)]
        (tmp_path / name).write_text("".join(t + "\n" for t in texts[name]))
    expected = [(name, i + 1, t) for name in sorted(texts) for i, t in enumerate(texts[name])]
    settings = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "10"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = read_lines(spark, str(tmp_path)).orderBy("seq").collect()
        assert read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        loose = read_lines(spark, str(tmp_path), numbered=False).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert [r.seq for r in found] == list(range(len(expected)))
    assert [(r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in found] == expected
    for name in texts:
        mine = sorted((r for r in loose if r.file.endswith(name)), key=lambda r: r.seq)
        assert [r.value for r in mine] == texts[name]


def rows_for_spill(spark):
    return log_frame(
        spark,
        [
            {"message": "naïve\nline", "timestamp": at(0.123456), "subsystem": "com.a", "level": "Error"},
            event("begin", 1, id=Decimal("18000000000000000019"), pid=3),
            {"message": "", "processName": "Other", "level": "Debug"},
        ],
    )


def test_spill_round_trip(spark, tmp_path):
    path = str(tmp_path / "spill")
    logs = rows_for_spill(spark)
    write_spill(logs, path)
    written = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert all(list(r) == sorted(r) and None not in r.values() and "seq" not in r for r in written)
    assert replay_spill(spark, path).orderBy("seq").collect() == logs.orderBy("seq").collect()
    kept = replay_spill(spark, path, FilterSpec(process="testapp", level="error"))
    assert [r.message for r in kept.collect()] == ["naïve\nline"]
    write_spill(logs.limit(1), path)
    assert replay_spill(spark, path).count() == 1


def test_spill_must_not_replace_its_source(spark, tmp_path):
    path = str(tmp_path / "spill")
    write_spill(rows_for_spill(spark), path)
    with pytest.raises(ValueError, match="must differ"):
        write_spill(replay_spill(spark, path), path)


def test_replay_names_the_first_bad_line(spark, tmp_path):
    good = '{"level":"Error","message":"m","pid":1,"processName":"p","timestamp":"2024-01-15T10:30:45Z"}'
    file = tmp_path / "spill.ndjson"
    file.write_text(f"{good}\n\n   \n{good}\n")
    assert replay_spill(spark, str(file)).count() == 2
    spoiled = [
        "{not valid json}", good.replace("Error", "error"), good.replace('"pid":1,', ""), good.replace('"m"', "5"),
        good.replace("2024-01-15T10:30:45Z", "yesterday"), good[:-1] + ',"signpostType":"Begin"}',
    ]
    for text in spoiled:
        file.write_text(f"{good}\n{text}\n{good}\n{{}}\n")
        with pytest.raises(SpillError, match=r"spill\.ndjson:2$"):
            replay_spill(spark, str(file))


def test_scans(spark, tmp_path):
    path = str(tmp_path / "archive.txt")
    (tmp_path / "archive.txt").write_text(f"{FULL}\ngarbage\n" + "{%s}\n" % TIME)
    assert scan_archive(spark, path, format="text").count() == 1
    assert scan_archive(spark, path, FilterSpec(info=True), format="text").head().source is None
    assert scan_archive(spark, path, FilterSpec(info=True), format="text", include_source=True).where("source is not null").count() == 1
    with pytest.raises(ValueError, match="time range"):
        scan_historical(spark, path, format="text")
    assert scan_historical(spark, path, FilterSpec(info=True), format="text", last="1h", now="2024-01-15 11:00:00").count() == 2
    assert scan_historical(spark, path, FilterSpec(info=True), format="text", start="2024-01-16").count() == 0
    with pytest.raises(ValueError, match="format"):
        scan_archive(spark, path, format="xml")


def test_structured_output(spark):
    logs = rows_for_spill(spark)
    shown = structured_output(logs)
    assert shown.columns == [
        "timestamp", "process", "pid", "level", "message", "subsystem", "category", "threadID", "activityID",
        "processImagePath", "senderImagePath", "traceID", "eventType", "source",
    ]
    text = structured_json(logs.where("seq = 0")).head().value
    assert json.loads(text) == {
        "timestamp": "2026-06-26T13:00:00.123456Z", "process": "TestApp", "pid": 42, "level": "Error",
        "message": "naïve\nline", "subsystem": "com.a",
    }
    assert source_projection(logs).schema == logs.schema
