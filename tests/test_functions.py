import pytest
from pyspark.sql import functions as F
from rows import at, log_frame

from emberlog import functions as fn


def column(spark, values, kind, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("v"))).collect()]


def test_durations(spark):
    good = {
        "5s": 5, "10S": 10, "2m": 120, "3M": 180, "1h": 3600, "2H": 7200, "30": 30, "1.5m": 90, "  5s  ": 5,
        "0.5s": 0.5, ".5h": 1800, "+2": 2, "1e2s": 100,
    }
    bad = ["", "   ", "abc", "-5s", "0s", "5x", "s", "5 s", "1h30m"]
    assert column(spark, list(good), "string", fn.parse_duration) == [float(v) for v in good.values()]
    assert column(spark, bad + [None], "string", fn.parse_duration) == [None] * (len(bad) + 1)
    for text, seconds in good.items():
        assert fn.duration_seconds(text) == seconds
    for text in bad:
        with pytest.raises(ValueError, match="--timeout"):
            fn.duration_seconds(text, "--timeout")


def test_relative_text(spark):
    us = [None, 312_000, 5_500_000, 125_000_000, 3_723_000_000, -1_500_000, 0, 59_999_600, 59_999_400, 3_599_999_000]
    assert column(spark, us, "long", fn.relative_text) == [
        "+0.000s", "+0.312s", "+5.500s", "+2m05.00s", "+1h02m", "-1.500s", "+0.000s", "+60.000s", "+59.999s",
        "+59m60.00s",
    ]


def test_format_ms(spark):
    us = [128_000, 1_100, None, 99_960, 100_500, 0, -2_340, -128_000]
    assert column(spark, us, "long", fn.format_ms) == [
        "128ms", "1.1ms", "-", "100.0ms", "101ms", "0.0ms", "-2.3ms", "-128.0ms",
    ]


def test_round_ms(spark):
    assert column(spark, [42.0000001, 1.23456, None], "double", fn.round_ms) == [42.0, 1.235, None]


def test_levels(spark):
    names = ["default", "INFO", "Debug", "error", "Fault", "notice", None]
    assert column(spark, names, "string", fn.parse_level) == [
        "Default", "Info", "Debug", "Error", "Fault", "Default", "Default",
    ]
    assert column(spark, names, "string", lambda c: fn.parse_level(c, unknown=None))[-2:] == [None, None]
    levels = ["Debug", "Info", "Default", "Error", "Fault"]
    assert column(spark, levels, "string", fn.level_rank) == [0, 1, 2, 3, 4]
    assert column(spark, levels, "string", fn.level_code) == [0, 1, 2, 16, 17]
    with pytest.raises(ValueError):
        fn.levels_at_least("loud")


def test_signpost_types(spark):
    assert column(spark, ["Begin", "END", "event", "other", None], "string", fn.parse_signpost_type) == [
        "begin", "end", "event", None, None,
    ]


def test_basename(spark):
    paths = ["/Applications/Finder.app/Contents/MacOS/Finder", "/a/b//", "name", "/", None]
    assert column(spark, paths, "string", fn.path_basename) == ["Finder", "b", "name", "/", None]


def test_split_csv(spark):
    texts = [" a , b ,  c ", "a,,b,", None, "", " , ,", "one two"]
    assert column(spark, texts, "string", fn.split_csv) == [["a", "b", "c"], ["a", "b"], [], [], [], ["one two"]]


def test_timestamps(spark):
    texts = [
        "2023-07-09T21:05:06.700801Z", "2023-07-09T21:05:06Z", "2023-07-09T21:05:06.5+02:00",
        "2025-03-04 09:17:08.250641+0200", "2023-07-09", "nonsense", "", None,
    ]
    found = column(spark, texts, "string", lambda c: fn.parse_timestamp(c).cast("timestamp_ntz").cast("string"))
    assert found == [
        "2023-07-09 21:05:06.700801", "2023-07-09 21:05:06", "2023-07-09 19:05:06.5", "2025-03-04 07:17:08.250641",
        None, None, None, None,
    ]


def test_format_source(spark):
    schema = "s struct<symbol:string,file:string,line:int,image:string>"
    values = [("-[A b]", "F.swift", 42, "Kit"), (None, "F.swift", 0, ""), ("", "", 3, None), (None, None, None, None), ("f", None, 5, None)]
    frame = spark.createDataFrame([(v,) for v in values], schema)
    assert [r[0] for r in frame.select(fn.format_source(F.col("s"))).collect()] == [
        "Kit -[A b] F.swift:42", "F.swift", None, None, "f",
    ]


def test_render(spark):
    row = log_frame(
        spark,
        [
            {"timestamp": at(1.25), "subsystem": "com.test.app", "category": "general", "level": "Info", "message": "Hello world"},
            {"timestamp": at(1.25), "subsystem": None, "category": "general", "senderImagePath": "/usr/lib/libx.dylib", "message": ""},
        ],
    ).orderBy("seq")
    shown = row.select(
        fn.render_plain(), fn.render_compact(), fn.render_plain(False, False, False, False), fn.render_detail(), fn.render_kv()
    ).collect()
    assert tuple(shown[0]) == (
        "13:00:01.250 [INFO] TestApp[42] (com.test.app:general) Hello world",
        "13:00:01.250 [INFO] Hello world",
        "Hello world",
        "2026-06-26T13:00:01.250Z [Info] TestApp (42) [com.test.app] [general] Hello world",
        "timestamp: 2026-06-26T13:00:01.250Z\nprocess: TestApp\npid: 42\nlevel: Info\nmessage: Hello world\n"
        "subsystem: com.test.app\ncategory: general",
    )
    assert tuple(shown[1])[:2] == ("13:00:01.250 [DEFAULT] TestApp[42] ", "13:00:01.250 [DEFAULT] ")
    assert shown[1][3] == "2026-06-26T13:00:01.250Z [Default] TestApp (42) [general] <libx.dylib> "


def test_highlight(spark):
    texts = ["an Error and error", "none", "ÉTÉ été"]
    assert column(spark, texts, "string", lambda c: fn.highlight(c, "error|été", "$\\")) == [
        "an $\\Error$\\ and $\\error$\\", "none", "$\\ÉTÉ$\\ $\\été$\\",
    ]
