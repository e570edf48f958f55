"""Ordered operators against plain loops, with ranges so narrow that every boundary case occurs."""

import random

import pytest
from pyspark.sql import functions as F
from rows import at, log_frame

from emberlog.operators.ordered import collapse_runs, dedup_consecutive, rank_rows, relative_time, with_neighbours, with_range

RANGES = [1, 2, 7, 64, 300]


def sparse(n: int, seed: int) -> list[int]:
    """Unique order numbers with gaps, some negative."""
    chance = random.Random(seed)
    found, at_ = [], -40
    for _ in range(n):
        at_ += chance.choice([1, 1, 1, 2, 3, 9, 40])
        found.append(at_)
    return found


@pytest.mark.parametrize("ranges", RANGES)
def test_collapse_runs(spark, ranges):
    chance = random.Random(7)
    rows = [(o, chance.choice("aaab") if i % 97 < 60 else "a") for i, o in enumerate(sparse(400, 1))]
    rows += [(o, None) for o in range(5000, 5020)]
    expected = []
    for order, value in rows:
        if expected and expected[-1][1] == value:
            expected[-1][2] += 1
        else:
            expected.append([order, value, 1])
    chance.shuffle(rows)
    runs = collapse_runs(spark.createDataFrame(rows, "seq long, message string"), ranges=ranges)
    assert sorted(map(list, runs.collect())) == expected


@pytest.mark.parametrize("ranges", RANGES)
def test_collapse_weighted(spark, ranges):
    rows = [(1, "a", 3), (2, "a", 2), (8, "b", 1), (9, "b", 4), (33, "b", 1), (70, "a", 1)]
    runs = collapse_runs(spark.createDataFrame(rows, "seq long, message string, repeat_count long"), ranges=ranges)
    assert sorted(map(tuple, runs.collect())) == [(1, "a", 5), (8, "b", 6), (70, "a", 1)]


@pytest.mark.parametrize("ranges", RANGES)
def test_neighbours_with_a_hot_key(spark, ranges):
    chance = random.Random(3)
    rows = [(o, chance.choice(["hot", "hot", "hot", "a", "b", None]), i) for i, o in enumerate(sparse(300, 2))]
    expected = []
    for key in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == key]
        for before, row, after in zip([None] + mine, mine, mine[1:] + [None]):
            expected.append((row[0], before and before[2], after and after[2]))
    chance.shuffle(rows)
    frame = spark.createDataFrame(rows, "seq long, k string, v int")
    for hot_rows in (1, 20, 1000, None):  # all keys are cut into ranges, some, and none
        found = with_neighbours(frame, {"before": "v"}, {"after": "v"}, keys=("k",), ranges=ranges, hot_rows=hot_rows)
        assert sorted(tuple(r)[:1] + tuple(r)[3:] for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("ranges", [1, 5, 64])
@pytest.mark.parametrize("limit, tail", [(None, 0), (1, 0), (137, 0), (5000, 0), (10, 7), (0, 3), (200, 200)])
def test_rank_rows(spark, ranges, limit, tail):
    rows = sparse(250, 4)
    numbered = list(enumerate(rows, 1))
    expected = numbered if limit is None else [(r, o) for r, o in numbered if r <= limit or r > 250 - tail]
    random.Random(5).shuffle(rows)
    frame = spark.createDataFrame([(o,) for o in rows], "seq long")
    found = rank_rows(frame, F.col("seq"), limit=limit, tail=tail, total="n", ranges=ranges).collect()
    assert sorted((r["rank"], r.seq) for r in found) == expected
    assert {r.n for r in found} == {250}


def test_dedup_text(spark):
    messages = ["same", "same", "same", "repeated", "repeated", "new", "same", ""]
    rows = [{"message": m, "level": "Error" if i % 2 else "Info", "pid": i} for i, m in enumerate(messages)]
    found = dedup_consecutive(log_frame(spark, rows)).orderBy("seq").collect()
    assert [r.text for r in found] == ["same (x3)", "repeated (x2)", "new", "same", ""]
    assert [r.pid for r in found] == [0, 3, 5, 6, 7]


def test_relative_time(spark):
    rows = [{"timestamp": at(s)} for s in (0, 1.0, 1.5, 1.25, 126.25, 3849.25)]
    found = relative_time(log_frame(spark, rows)).orderBy("seq").collect()
    assert [r.relative for r in found] == ["+0.000s", "+1.000s", "+0.500s", "-0.250s", "+2m05.00s", "+1h02m"]


def test_no_rows(spark):
    empty = log_frame(spark, [])
    assert dedup_consecutive(empty).count() == 0
    assert relative_time(empty).count() == 0
    assert rank_rows(empty, F.col("seq"), limit=3).count() == 0


@pytest.mark.parametrize("spread", ["random", "dense", "lumpy"])
def test_no_task_has_twice_the_mean(spark, spread):
    """Ranges are as even on random 63-bit orders, and on ones that lie in lumps, as on dense ones."""
    orders = {
        "random": "xxhash64(id)",
        "dense": "id",
        "lumpy": "case when id % 3 = 0 then id * 1000003 * 1000003 else id end",
    }
    rows = spark.range(100_000).selectExpr(f"{orders[spread]} AS seq", "id")
    sizes = [r.n for r in with_range(rows, "seq", 16).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * 100_000 / 16
    in_tasks = with_range(rows, "seq", 16).repartitionById(16, F.col("_range")).withColumn("task", F.spark_partition_id())
    assert max(r["count"] for r in in_tasks.groupBy("task").count().collect()) == max(sizes)


def test_sparse_orders(spark):
    """Random 63-bit orders give what the dense ones give."""
    rows = spark.range(3000).selectExpr("id AS dense", "xxhash64(id) AS seq", "id % 7 AS message")
    ranked = rank_rows(rows, F.col("seq"), ranges=9)
    expected = [(r.seq, i) for i, r in enumerate(sorted(rows.collect(), key=lambda r: r.seq), 1)]
    assert sorted((r.seq, r["rank"]) for r in ranked.collect()) == sorted(expected)
    runs = collapse_runs(rows.withColumn("message", F.expr("seq >> 60")), ranges=9)
    assert sorted(r.message for r in runs.collect()) == list(range(-8, 8))
    assert runs.agg(F.sum("repeat_count")).head()[0] == 3000
