"""Markers of a table against looking for each one in each line."""

import random

import pytest
from executed import executed, metric

from emberlog.operators import coverage
from emberlog.operators.coverage import coverage_table, find_markers, redaction_table

SOUGHT = ["", "a", "ab", "abc", "abcd", "abcde", "bcda", "é", "été!", "\n", "a\nb", "aaaa", "aaaaaaaa", "zzzz", None, "日本語の", "🙂🙂🙂🙂b"]


@pytest.fixture(scope="module")
def lines():
    chance = random.Random(6)
    made = ["".join(chance.choice(["a", "b", "c", "d", "e", "é", "été!", "\n", "aaaa", "日本語", "の", "🙂"]) for _ in range(chance.randint(0, 14))) for _ in range(300)]
    return [(chance.choice(["x", "y", None]), t) for t in made] + [("y", None), ("x", ""), ("x", "abcde" * 3000)]


@pytest.mark.parametrize("part_bytes", [coverage.MARKER_BYTES, 150])
def test_find_markers(spark, lines, monkeypatch, part_bytes):
    monkeypatch.setattr(coverage, "MARKER_BYTES", part_bytes)
    frame = spark.createDataFrame(lines, "source string, text string").repartition(3)
    markers = spark.createDataFrame([(f"m{i}", s) for i, s in enumerate(SOUGHT)] + [("m1", "a")], "marker string, sought string")
    found = find_markers(frame, markers, secret="ab").collect()
    expected = {}
    for i, sought in enumerate(SOUGHT):
        for source, text in lines:
            if sought is not None and text is not None and sought in text:
                n, leaked = expected.get((source, f"m{i}"), (0, False))
                expected[source, f"m{i}"] = (n + 1, leaked or "ab" in text)
    assert {(r.source, r.marker): (r.n_lines, r.leaked) for r in found} == expected and len(found) == len(expected)
    grid = {r.marker: (r.x, r.y) for r in coverage_table(frame, markers, ["x", "y"]).collect()}
    assert grid == {f"m{i}": tuple("YES" if (s, f"m{i}") in expected else "no" for s in "xy") for i in range(len(SOUGHT))}


def test_no_markers_and_no_lines(spark, lines):
    frame = spark.createDataFrame(lines, "source string, text string")
    markers = spark.createDataFrame([("m", "a")], "marker string, sought string")
    assert find_markers(frame, markers.limit(0)).count() == 0
    assert find_markers(frame.limit(0), markers).count() == 0
    assert redaction_table(frame, markers.limit(0), "x").columns == ["source", "marker", "leaked"]


def test_ten_thousand_markers_have_the_same_plan(spark):
    frame = spark.range(200).selectExpr("'x' AS source", "'line of marker <' || id || '>' AS text")

    def made(n):
        found = find_markers(frame, spark.range(n).selectExpr("'m' || id AS marker", "'marker <' || id || '>' AS sought"))
        return found, found._jdf.queryExecution().optimizedPlan().treeString().count("\n")

    few, many = made(10), made(10_000)
    assert few[1] == many[1] and few[0].count() == 10 and many[0].count() == 200


def test_markers_that_share_a_text_meet_no_line(spark):
    """Rows that a line meets are as many as the different texts in it, however many markers share them."""
    frame = spark.range(300).selectExpr("'x' AS source", "'line of marker <' || id % 3 || '>, user 12345678' AS text")
    sought = "CASE id % 3 WHEN 0 THEN '<1>' WHEN 1 THEN 'user 1' || id ELSE 'a longer text than a key has: line of' END"
    markers = spark.range(3000).selectExpr("'m' || id AS marker", f"{sought} AS sought")
    found = find_markers(frame, markers, secret="<1>")
    made = {(r.marker, r.n_lines, r.leaked) for r in found.collect()}
    assert made == {(f"m{i}", 100, True) for i in range(0, 3000, 3)}  # "user 1" and id: 2345678 and so on are no ids
    joined = [metric(node, "numOutputRows") for name, node in executed(found) if "Join" in name]
    assert joined and max(joined) <= 20_000  # 100 000 finds of markers


def test_malformed_text_before_a_marker(spark):
    frame = spark.sql("SELECT 'x' AS source, CAST(x'61e38178797ae3' AS STRING) || 'found 🙂 found' AS text")
    markers = spark.createDataFrame([("a", "found"), ("b", "🙂 f"), ("c", "und 🙂 found"), ("d", "yz")], "marker string, sought string")
    assert {(r.marker, r.n_lines) for r in find_markers(frame, markers).collect()} == {(m, 1) for m in "abcd"}
