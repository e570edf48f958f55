import datetime as dt
import random
import re

import pytest
from executed import executed, metric
from pyspark.sql import functions as F
from rows import at, log_frame

from emberlog.operators import filters as f
from emberlog.operators import profiles as rules_of_tables
from emberlog.operators.filters import FilterSpec
from emberlog.operators.profiles import Profile, match_profiles, profile_match, summarise_matches


def keeps(spark, predicate, *rows):
    frame = log_frame(spark, list(rows)).orderBy("seq")
    return [r[0] for r in frame.select(predicate).collect()]


def test_process(spark):
    assert keeps(spark, f.process_ci("testapp"), {"processName": "TestApp"}, {"processName": "Other"}, {"processName": None}) == [True, False, False]
    assert keeps(spark, f.process_ci("testapp", case_sensitive=True), {"processName": "TestApp"}) == [False]
    paths = [{"processImagePath": p} for p in ("/Apps/Finder", "/Apps/finder", "/Apps/XFinder", "Finder", None)]
    assert keeps(spark, f.process_path_suffix(["Finder", "Dock"]), *paths) == [True, False, False, False, False]


def test_subsystem(spark):
    rows = [{"subsystem": s} for s in ("com.test", "com.test.app", "com.testing", "com.other", None)]
    assert keeps(spark, f.subsystem_prefix(["com.test"]), *rows) == [True, True, True, False, False]
    assert keeps(spark, f.subsystem_exact("com.test"), *rows) == [True, False, False, False, False]


def test_level_floor(spark):
    rows = [{"level": name} for name in ("Debug", "Info", "Default", "Error", "Fault")]
    assert keeps(spark, f.min_level("error"), *rows) == [False, False, False, True, True]
    assert keeps(spark, f.min_level("debug"), *rows) == [True] * 5


def test_grep(spark):
    rows = [{"message": m} for m in ("error: connection timeout", "Error with timeout", "timeout error", "É", None)]
    assert keeps(spark, f.grep("error.*timeout"), *rows) == [True, True, False, False, False]
    assert keeps(spark, f.grep("error.*timeout", case_sensitive=True), *rows) == [True, False, False, False, False]
    assert keeps(spark, f.exclude_grep("é"), *rows) == [True, True, True, False, True]


def test_combinations(spark):
    rows = [{"pid": 1, "subsystem": None}, {"pid": 2, "subsystem": "a"}]
    assert keeps(spark, f.not_pred(F.col("subsystem") == "a"), *rows) == [True, False]
    assert keeps(spark, f.any_of([]), *rows) == [True, True]
    assert keeps(spark, f.filter_chain([]), *rows) == [True, True]
    assert keeps(spark, f.filter_chain([f.pid_eq(2), f.subsystem_exact("a"), f.category_eq(["x"])]), *rows) == [False, False]


@pytest.mark.parametrize(
    "spec, emitted",
    [
        (FilterSpec(subsystem="com.a"), (True, True)),
        (FilterSpec(subsystem="com.a", level="error"), (False, False)),
        (FilterSpec(subsystem="com.a", info=True), (True, False)),
        (FilterSpec(level="debug"), (True, True)),
        (FilterSpec(level="info"), (True, False)),
        (FilterSpec(level="fault"), (False, False)),
        (FilterSpec(process="x"), (False, False)),
        (FilterSpec(debug=True), (True, True)),
        (FilterSpec(signpost=True), (True, True)),
        (FilterSpec(), (False, False)),
    ],
)
def test_emission(spec, emitted):
    assert spec.emission() == emitted


def test_spec_reads_names():
    assert FilterSpec(process=" a , b ,  c ").process == ("a", "b", "c")
    assert FilterSpec(category=["a", "", " b "]).category == ("a", "b")
    assert FilterSpec(level="ERROR").level == "Error"
    with pytest.raises(ValueError):
        FilterSpec(level="loud")


def test_invalid_regex_names_the_field(spark):
    logs = log_frame(spark, [{}])
    with pytest.raises(ValueError, match="Invalid 'grep' regex"):
        f.scan_filter(logs, FilterSpec(grep="[unclosed"))
    with pytest.raises(ValueError, match="Invalid 'exclude_grep' regex"):
        f.scan_filter(logs, FilterSpec(exclude_grep="(a"))


def test_live_and_replay_differ(spark):
    logs = log_frame(
        spark,
        [
            {"processName": "Finder", "processImagePath": "/A/Finder"},
            {"processName": "Finder", "processImagePath": "/A/Finder", "level": "Debug"},
            {"processName": "Finder", "processImagePath": "/A/Finder", "eventType": "signpostEvent"},
            {"processName": "finder", "processImagePath": "/A/finder"},
        ],
    )
    spec = FilterSpec(process="Finder")
    assert sorted(r.seq for r in f.scan_filter(logs, spec, "live").collect()) == [0]
    assert sorted(r.seq for r in f.scan_filter(logs, spec, "replay").collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        f.scan_filter(logs, spec, "other")


def test_signposts_ignore_level_and_text(spark):
    logs = log_frame(spark, [{"eventType": "signpostEvent", "level": "Debug", "pid": 1}, {"pid": 1}, {"eventType": "signpostEvent", "pid": 2}])
    spec = FilterSpec(pid=1, level="fault", grep="nothing", signpost=True)
    assert [r.seq for r in f.signpost_filter(logs, spec).collect()] == [0]


def test_time_range(spark):
    logs = log_frame(spark, [{"timestamp": at(s)} for s in (0, 1, 2, 3)])

    def seqs(**bounds):
        return sorted(r.seq for r in f.time_range(logs, **bounds).collect())

    assert seqs() == [0, 1, 2, 3]
    assert seqs(start=at(1), end=at(2)) == [1, 2]
    assert seqs(start=at(2)) == [2, 3]
    assert seqs(last="1.5s", now=at(3)) == [2, 3]
    assert seqs(last="boot", boot=at(1)) == [1, 2, 3]
    for bad in (dict(last="5s", start=at(0)), dict(end=at(1)), dict(last="boot"), dict(last="0s"), dict(last="x")):
        with pytest.raises(ValueError):
            f.time_range(logs, **bad)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "logs")
    log_frame(spark, [{"subsystem": "com.a", "timestamp": at(s), "log_date": None} for s in range(4)]).withColumn(
        "log_date", F.col("timestamp").cast("date")
    ).write.partitionBy("log_date").parquet(path)
    logs = f.time_range(spark.read.parquet(path), start=dt.datetime(2026, 6, 26), end=dt.datetime(2026, 6, 27))
    kept = f.scan_filter(logs, FilterSpec(pid=42, subsystem="com.a", category="x", level="error", grep="y")).select("seq")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: (.*)", plan)
    for part in ("EqualTo(pid,42)", "StringStartsWith(subsystem,com.a)", "EqualTo(category,x)", "In(level, [Error,Fault])", "GreaterThanOrEqual(timestamp"):
        assert part in pushed[1]
    assert "senderImagePath" not in pushed[2]
    assert "log_date" in re.search(r"PartitionFilters: \[(.*?)\], Pushed", plan)[1]


def test_profiles(spark):
    assert Profile().is_empty() and not Profile(info=False).is_empty()
    mine = Profile(process="a", level="error", info=True)
    assert mine.overridden(Profile(level="fault", pid=3)) == Profile(process="a", level="fault", pid=3, info=True)
    assert Profile(level="loud").spec().level is None
    logs = log_frame(spark, [{"pid": 1, "level": "Error"}, {"pid": 2}, {"pid": 3, "level": "Error"}])
    found = profile_match(logs, {"one": Profile(pid=1), "bad": Profile(level="error"), "all": Profile()})
    assert sorted((r.seq, r.profile) for r in found.collect()) == [
        (0, "all"), (0, "bad"), (0, "one"), (1, "all"), (2, "all"), (2, "bad"),
    ]


def table_of(spark, profiles):
    names = ["process", "pid", "subsystem", "category", "level", "grep", "exclude_grep"]
    rows = [(name, *[getattr(profile, n) for n in names]) for name, profile in profiles.items()]
    kinds = ", ".join(f"{n} {'long' if n == 'pid' else 'string'}" for n in names)
    return spark.createDataFrame(rows, f"profile string, {kinds}")


def test_profiles_of_a_table_match_as_the_others(spark):
    """Random rules and rows, nulls everywhere, lists with repeats and with prefixes of each other."""
    chance = random.Random(8)

    def some(*values):
        return chance.choice([None, None, *values])

    rows = [
        {"processName": some("A", "b"), "pid": some(1, 2), "subsystem": some("com.a", "com.ab.c", "x"), "category": some("c", "d", ""),
         "level": some("Debug", "Default", "Error"), "message": some("one", "TWO", "")}
        for _ in range(60)
    ]
    logs = log_frame(spark, rows)
    profiles = {
        str(i): Profile(
            process=some("a, B,a", "a"), pid=some(1, 2), subsystem=some("com.a,com,com.ab", "com.ab", " , "), category=some("c,d", "c"),
            level=some("error", "Info", "loud"), grep=some("o"), exclude_grep=some("^t", "e$"),
        )
        for i in range(80)
    }
    for overrides in (None, Profile(level="default"), Profile(grep="n", pid=1)):
        expected = profile_match(logs, profiles, overrides).select("seq", "profile").collect()
        found = match_profiles(logs, table_of(spark, profiles), overrides).select("seq", "profile").collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, expected))
    assert match_profiles(logs, table_of(spark, profiles).limit(0)).count() == 0


def test_ten_thousand_profiles_have_the_same_plan(spark):
    logs = log_frame(spark, [{"pid": i} for i in range(50)])

    def plan(n):
        rules = spark.range(n).selectExpr("string(id) AS profile", "id AS pid", "if(id % 2 = 0, 'com.test', null) AS subsystem")
        found = match_profiles(logs, rules)
        return found, found._jdf.queryExecution().optimizedPlan().treeString().count("\n")

    few, many = plan(10), plan(10_000)
    assert few[1] == many[1] and many[0].count() == 25 and few[0].count() == 5


@pytest.mark.parametrize("sent", [rules_of_tables.SENT_ENTRIES, 0])
def test_profiles_that_say_the_same_are_matched_once(spark, monkeypatch, sent):
    monkeypatch.setattr(rules_of_tables, "SENT_ENTRIES", sent)
    logs = log_frame(spark, [{"pid": i % 3, "level": "Error" if i % 2 else "Debug", "message": str(i)} for i in range(200)])
    given = {str(i): Profile(pid=i % 5 if i % 4 else None, level="error", grep="7" if i % 7 == 0 else None) for i in range(400)}
    # A name twice with the same rule and once with another, and one without a name.
    rules = table_of(spark, given)
    rules = rules.unionByName(rules.where("profile IN ('1', '3')")).unionByName(rules.where("profile = '0'").selectExpr("'1' AS profile", "* EXCEPT (profile)"))
    rules = rules.unionByName(rules.where("profile = '8'").withColumn("profile", F.lit(None).cast("string")))
    for overrides in (None, Profile(pid=1)):
        pairs = match_profiles(logs, rules, overrides).groupBy("profile")
        expected = pairs.agg(F.count("*").alias("n"), F.min("seq"), F.max("seq"), F.sum("seq")).collect()
        made = summarise_matches(logs, rules, overrides)
        assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, map(tuple, expected))) and len(expected) > 200
    joined = [metric(node, "numOutputRows") for name, node in executed(summarise_matches(logs, rules)) if "Join" in name]
    assert joined and max(joined) < 5_000  # more than 20 000 pairs of rows and profiles
