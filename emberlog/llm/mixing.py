"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import free_name, materialize


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: 52 bits, the same in every run and engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, 2, ... until what is left cannot be drawn.

    Terms are summed from their logarithms, so that large rates do not underflow.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("cs"))

    def step(a, k):
        lp = a["lp"] + F.ln(rate) - F.ln(k.cast("double"))
        c = a["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.array_append(a["cs"], c).alias("cs"))

    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(
        F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["cs"])
    )


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None, epochs: float, power: float, source_col: str, text_col: str
) -> DataFrame:
    """One row per source: mix_source, mix_size, mix_rate, mix_steps."""
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(
        (F.sum(F.coalesce(F.char_length(F.col(text_col)), F.lit(0))) + F.count("*")).cast("double").alias("mix_size")
    )
    if weights is None:
        share = F.pow("mix_size", F.lit(power))
    else:
        share = F.lit(0.0)
        for source, weight in weights.items():
            share = F.when(F.col("mix_source") == source, F.lit(float(weight))).otherwise(share)
    sizes = materialize(sizes.withColumn("mix_share", share), "source-sizes")
    total = sizes.agg(F.sum("mix_size").alias("size"), F.sum("mix_share").alias("share"))
    wanted = F.lit(float(epochs)) * F.col("size") * F.col("mix_share") / F.col("share") / F.col("mix_size")
    # One row of totals beside each source: an equality on a constant, not a cross join.
    joined = sizes.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    rated = joined.select("mix_source", "mix_size", F.when(F.col("share") > 0, wanted).otherwise(0.0).alias("mix_rate"))
    return rated.withColumn("mix_steps", poisson_steps(F.col("mix_rate")))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    power: float = 0.5,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Each document as often as a Poisson draw says, in one global random order.

    The mean of the draw is its source's target repetition rate: `epochs` times the size of the
    corpus, times the source's share, over the source's size. A size is characters plus one for
    each document. Shares are `weights` over their sum, or else the sizes to `power`, which lifts
    small sources. The draw inverts the distribution at a number hashed from seed and id, so a
    document's count does not depend on the others, on partitions or on retries.

    Returns the columns of docs, then mix_copies, mix_copy from 1, and mix_key, the hash by which
    rows are ordered (range-partitioned, so a hot source spreads over all tasks). Sources missing
    from `weights` have share 0 and go. A null source is a source of its own, share 0 if weights
    are given. Null text has no characters. Rows with the same id draw the same count; null ids
    draw as one id. Columns of docs that are called like the added ones stay, and the added ones
    get underscores behind their names (`free_name`). Without documents no rows come.

    The table of rates has a row per source; Spark broadcasts it while its written size is below
    its own threshold and otherwise joins by shuffle, splitting a hot source's partition.
    """
    rates = materialize(source_rates(docs, weights, epochs, power, source_col, text_col), "source-rates")
    inner = ("mix_source", "mix_steps", "mix_copies", "mix_copy", "mix_key")
    source, steps, n, nth, place = (free_name(docs.columns, name) for name in inner)
    rates = rates.select(F.col("mix_source").alias(source), F.col("mix_steps").alias(steps))
    drawn = docs.join(rates, F.col(source_col).eqNullSafe(F.col(source)))
    u = uniform(F.lit(seed), F.col(id_col))
    drawn = drawn.withColumn(n, F.size(F.filter(steps, lambda c: c <= u)).cast("long"))
    copies = drawn.where(F.col(n) > 0).select(
        *docs.columns, n, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias(nth)
    )
    key = F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), nth))
    return copies.withColumn(place, key).orderBy(place)
