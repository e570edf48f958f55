"""Operators that depend on arrival order, in bounded tasks.

Looking at the previous row, numbering rows or joining runs needs all rows in one order, and
a plain window over them puts everything (or one hot key) into one task. Here the order axis
is cut into ranges of about equal numbers of rows instead, at quantiles of the order itself, so
that dense, sparse and lumpy orders spread alike. Each range is a task of its own; what only the
neighbours of a range can settle, its first and last rows, goes on to a second step, which has
at most two rows per range.

Where rows are looked at per key, only keys with very many rows are cut into ranges. A sketch of
the most frequent keys finds them; every other key is one window, settled at once. Whether a key
is cut changes no result, so what the sketch misses costs time at most.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.times import duration_us, relative_text

# Rows from which on a key is cut into ranges, and the most keys that are: a key with a smaller
# share of all rows is no larger than what a task of this many has anyway.
HOT_ROWS, HOT_KEYS = 1 << 16, 1 << 10
# Keys that the sketch of frequent keys holds, and the inverse of the error of quantiles.
TRACKED, ACCURACY = 10_000, 1 << 16


def task_count(df: DataFrame) -> int:
    """How many ranges to cut: one per task of a shuffle."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_range(df: DataFrame, order: str, n: int, among: DataFrame | None = None) -> DataFrame:
    """Add `_range`, 0 to n - 1: contiguous ranges of `order` with about equally many rows.

    They are cut at quantiles, a mergeable sketch of one column, taken over `among` (by default
    all rows) as a scalar subquery. The range is the number of cuts up to a row's place, by
    halving.
    """
    if n == 1:
        return df.withColumn("_range", F.lit(0))
    quantiles = F.percentile_approx(order, [k / n for k in range(1, n)], ACCURACY)
    cuts = (df if among is None else among).agg(quantiles).scalar()
    steps = F.array(*[F.lit(1 << b) for b in reversed(range((n - 1).bit_length()))])

    def moved(at: Column, step: Column) -> Column:
        return at + F.when(F.col(order) >= F.get("_cuts", at + step - 1), step).otherwise(0)

    return df.withColumn("_cuts", cuts).withColumn("_range", F.aggregate(steps, F.lit(0), moved)).drop("_cuts")


def frequent_keys(df: DataFrame, key_hash: str, hot_rows: int) -> Column:
    """Hashes of the keys with about `hot_rows` rows or more, as a scalar subquery: at most HOT_KEYS."""
    met = df.agg(F.expr(f"approx_top_k({key_hash}, {HOT_KEYS}, {TRACKED})").alias("met"), F.count("*").alias("n"))
    least = F.greatest(F.lit(hot_rows), F.expr(f"n div {HOT_KEYS}"))
    hot = met.withColumn("least", least).select(F.expr("transform(filter(met, x -> x.count >= least), x -> x.item)"))
    return hot.scalar()


def with_neighbours(
    df: DataFrame,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    keys: tuple[str, ...] = (),
    order: str = "seq",
    ranges: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add columns of the row before and the row after, per key in `order`.

    `previous` and `following` map new column names to source columns; they are null where
    there is no such row. `order` must be a unique BIGINT within a key. Rows of one key go
    through one window, unless a sketch of the keys says that the key has `hot_rows` rows; with
    None, no key is looked for. Keys of a single row or few cost one shuffle.
    """
    previous, following = previous or {}, following or {}
    n = ranges or task_count(df)

    def packed(columns: dict[str, str]) -> Column:
        return F.struct(F.lit(True).alias("_there"), *[F.col(src).alias(name) for name, src in columns.items()])

    def step(rows: DataFrame, parts: list[str]) -> DataFrame:
        window = Window.partitionBy(*parts).orderBy(order)
        before, after = F.lag("_previous").over(window), F.lead("_following").over(window)
        if "_before" in rows.columns:
            before, after = F.coalesce("_before", before), F.coalesce("_after", after)
        return rows.withColumns({"_before": before, "_after": after})

    rows = df.withColumns({"_previous": packed(previous), "_following": packed(following)})
    settled = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    if not keys:
        # Packed once, below the shuffle: both steps then need the same columns, whatever is pruned
        # above, and share it.
        first = step(with_range(rows, order, n).repartitionById(n, F.col("_range")), ["_range"])
        done, rest = first.where(settled), first.where(~settled)
    elif hot_rows is None:
        done, rest = step(rows.withColumn("_range", F.lit(-1)), [*keys]), None
    else:
        hashed = df.select(F.xxhash64(*keys).alias("_hash"), order)
        frequent = frequent_keys(hashed, "_hash", hot_rows)
        hot = F.coalesce(F.array_contains(frequent, F.xxhash64(*keys)), F.lit(False))
        rows = with_range(rows.withColumn("_hot", hot), order, n, hashed.where(F.array_contains(frequent, F.col("_hash"))))
        rows = rows.withColumn("_range", F.when(F.col("_hot"), F.col("_range")).otherwise(-1))
        parts = [*keys, "_range"]
        done = step(rows, parts).where(~F.col("_hot") | settled).drop("_hot")
        rest = step(rows.where("_hot"), parts).where(~settled).drop("_hot")
    if rest is not None:
        done = done.union(step(rest, [*keys]))
    return done.select(
        *df.columns,
        *[F.col("_before")[name].alias(name) for name in previous],
        *[F.col("_after")[name].alias(name) for name in following],
    )


def collapse_runs(
    df: DataFrame,
    value: str = "message",
    order: str = "seq",
    count: str = "repeat_count",
    ranges: int | None = None,
) -> DataFrame:
    """Replace each run of consecutive equal `value`s by its first row and its length.

    If the count column is there already, rows stand for that many repeats. Collapsing twice
    is the same as collapsing once, so runs are collapsed within ranges first, and only the
    first and last run of each range are collapsed again with those of its neighbours.
    """
    n = ranges or task_count(df)

    def step(rows: DataFrame, parts: list[str]) -> DataFrame:
        window = Window.partitionBy(*parts).orderBy(order)
        to_here = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.lag(F.struct(F.col(value).alias("value"))).over(window)
        rows = rows.withColumns(
            {
                "_before": before,
                "_until": F.sum(count).over(to_here) - F.col(count),
                "_total": F.sum(count).over(whole),
            }
        )
        # A run known to start here stays apart from the one before it in the second step, which
        # need not be its real neighbour: the runs inside a range are settled and gone by then.
        joins = F.col("_before").isNotNull() & F.col("_before")["value"].eqNullSafe(F.col(value))
        heads = rows.where(F.col("_starts") | ~joins)
        after = F.lead("_until").over(window)
        return heads.withColumns(
            {
                count: F.coalesce(after, F.col("_total")) - F.col("_until"),
                "_starts": F.col("_starts") | F.col("_before").isNotNull(),
                "_ends": after.isNotNull(),
            }
        ).drop("_before", "_until", "_total")

    rows = df if count in df.columns else df.withColumn(count, F.lit(1).cast("long"))
    rows = with_range(rows.withColumn("_starts", F.lit(False)), order, n).repartitionById(n, F.col("_range"))
    first = step(rows, ["_range"])
    rest = step(first.where("not (_starts and _ends)").drop("_ends"), [])
    return rest.unionByName(first.where("_starts and _ends")).drop("_starts", "_ends", "_range")


def dedup_consecutive(logs: DataFrame, order: str = "seq") -> DataFrame:
    """First row of every run of equal messages, with `repeat_count` and the shown `text`.

    Process and level play no part in the comparison.
    """
    runs = collapse_runs(logs, order=order)
    times = F.when(
        F.col("repeat_count") > 1, F.concat(F.lit(" (x"), F.col("repeat_count").cast("string"), F.lit(")"))
    ).otherwise("")
    return runs.withColumn("text", F.concat(F.col("message"), times))


def relative_time(logs: DataFrame, order: str = "seq") -> DataFrame:
    """Add `delta_us` to the row shown before (null for the first) and its text `relative`."""
    shown = with_neighbours(logs, previous={"_shown": "timestamp"}, order=order)
    return (
        shown.withColumn("delta_us", duration_us(F.col("_shown"), F.col("timestamp")))
        .withColumn("relative", relative_text(F.col("delta_us")))
        .drop("_shown")
    )


def rank_rows(
    df: DataFrame,
    order: Column,
    rank: str = "rank",
    total: str | None = None,
    limit: int | None = None,
    tail: int = 0,
    ranges: int | None = None,
) -> DataFrame:
    """Number all rows from 1 along a unique BIGINT `order`.

    Counts per range give the number of rows before each range; numbering within ranges does
    the rest. With `limit`, only the first `limit` and the last `tail` rows are kept, and only
    the ranges holding those are shuffled; finding and counting the ranges needs one column.
    `total` names a column for the number of all rows. The ranges with their counts, one row
    each, go to every task.
    """
    n = ranges or task_count(df)
    # Never null, so that the join below infers no filter for one of its sides only.
    rows = with_range(df.withColumn("_order", order), "_order", n)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_rows"))
    along = Window.orderBy("_range")
    until = F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = counts.withColumns({"_start": until - F.col("_rows"), "_total": whole})
    if limit is not None:
        starts = starts.where((F.col("_start") < limit) | (F.col("_start") + F.col("_rows") > F.col("_total") - tail))
    numbered = rows.join(F.broadcast(starts.drop("_rows")), "_range").repartitionById(n, F.col("_range"))
    inside = Window.partitionBy("_range").orderBy("_order")
    numbered = numbered.withColumn(rank, F.col("_start") + F.row_number().over(inside))
    if limit is not None:
        numbered = numbered.where((F.col(rank) <= limit) | (F.col(rank) > F.col("_total") - tail))
    return numbered.select(*df.columns, rank, *([F.col("_total").alias(total)] if total else []))
