"""Benchmark decontamination by a broadcast hash set of word n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, free_name, materialize

# Fixed value: what separates words, after lower-casing A-Z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# n-grams up to this number are broadcast: 16 bytes each, so at most some 64 MB.
MOST_BROADCAST = 2_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), lambda w: w != "")


def _gram_hashes(hashes: Column, k: int) -> Column:
    """The hash of each k consecutive words, by position from 0; none if there are fewer."""
    n = F.size(hashes)
    return F.when(
        n >= k,
        F.transform(
            F.sequence(F.lit(0), n - k),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _located(hashes: Column, k: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(i.alias("i"), F.lit(k).alias("k"), h.alias("h")))


def item_grams(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """gram, k, items: each distinct window of the items, its number of words, the items that have it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
    k = F.least(F.size("words"), F.lit(window))
    grams = items.where(F.size("words") > 0).select(
        "item_id",
        k.alias("k"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k))).alias("g"),
    )
    return grams.groupBy(F.array_join("g", " ").alias("gram"), "k").agg(F.collect_set("item_id").alias("items"))


def _hash_of_gram(gram: Column, lengths: list[int]) -> Column:
    """The hash that _gram_hashes gives a window, from its text."""
    words = F.transform(F.split(gram, " "), lambda w: F.xxhash64(w))
    n = F.size(words)
    return F.coalesce(*[F.when(n == k, F.xxhash64(*[F.get(words, j) for j in range(k)])) for k in lengths])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, uid, n_words, n_hit, spans, items.

    spans are the hit stretches of words as (first, n), from 0, apart and in order; items are
    the ids, as sorted strings, of the items with an occurring window. An item with fewer words
    than a window is one window; one without words has none and never hits.

    Every window of a document is hashed and looked up in the set of item windows, which is
    broadcast while it has at most MOST_BROADCAST entries and joined by shuffle beyond that. Hits
    are then verified word by word against the document's text; only documents with a hit take
    part in that.

    Null text has no words. A null item_id hits but is not listed. Rows that repeat a doc_id are
    separate documents if their texts differ; if they are equal too, each gets the same answer.
    Other columns are not read. Without items nothing hits; without documents no rows come.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = own.withColumn("uid", F.xxhash64("doc_id", "text"))
    grams = materialize(item_grams(benchmark, window, item_id_col, item_text_col), "grams")
    # Between 1 and `window` rows, one aggregate over the benchmark: the lengths of its windows.
    sizes = {r["k"]: r["n"] for r in grams.groupBy("k").agg(F.count("*").alias("n")).where(F.col("k") <= window).collect()}
    lengths, bounded = sorted(sizes), sum(sizes.values()) <= MOST_BROADCAST

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if bounded else df

    hashed = grams.select((_hash_of_gram(F.col("gram"), lengths) if lengths else F.lit(0).cast("long")).alias("h")).distinct()
    found = own.withColumn("words", words_of(F.col("text"))).select(
        "uid", "doc_id", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hs")
    )
    windows = [_located(_gram_hashes(F.col("hs"), k), k) for k in lengths]
    # The first element stands for the document itself, so that one without hits keeps a row.
    itself = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("h")))
    rows = found.select("uid", "doc_id", "n_words", F.explode(reduce(F.concat, windows, itself)).alias("w"))
    rows = rows.select("uid", "doc_id", "n_words", "w.i", "w.k", "w.h")
    looked_up = rows.join(small(hashed.withColumn("in_set", F.lit(True))), "h", "left")
    looked_up = looked_up.where((F.col("i") < 0) | F.col("in_set"))
    documents = materialize(
        looked_up.groupBy("uid", "doc_id", "n_words").agg(
            F.sum((F.col("i") < 0).cast("int")).alias("copies"),
            F.collect_set(F.when(F.col("i") >= 0, F.struct("i", "k"))).alias("cands"),
        ),
        "lookups",
    )
    hit = documents.where(F.size("cands") > 0).select("uid", F.col("doc_id").alias("hit_doc_id"), "n_words", "cands")
    verified = (
        own.join(hit, "uid")
        .where(F.col("doc_id").eqNullSafe(F.col("hit_doc_id")))
        .dropDuplicates(["uid", "hit_doc_id", "n_words"])
        .withColumn("words", words_of(F.col("text")))
        .select(
            "uid",
            "hit_doc_id",
            F.explode(
                F.transform(
                    "cands",
                    lambda c: F.struct(
                        c["i"].alias("i"),
                        c["k"].alias("k"),
                        F.array_join(F.slice("words", c["i"] + 1, c["k"]), " ").alias("gram"),
                    ),
                )
            ).alias("c"),
        )
        .select("uid", "hit_doc_id", "c.*")
        .join(small(grams), ["gram", "k"])
        .groupBy("uid", "hit_doc_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("i", "k"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    )
    both = documents.join(
        verified.withColumnRenamed("uid", "hit_uid"),
        (F.col("uid") == F.col("hit_uid")) & F.col("doc_id").eqNullSafe(F.col("hit_doc_id")),
        "left",
    )
    positions = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["i"], h["i"] + h["k"] - 1))))
    # Of sorted distinct positions, those of one stretch share position minus rank.
    ranked = F.transform(F.array_sort(positions), lambda p, r: F.struct(p.alias("p"), (p - r).alias("run")))
    runs = F.array_sort(F.array_distinct(F.transform(ranked, lambda x: x["run"])))
    one = both.withColumn("ranked", ranked).withColumn("runs", runs)
    one = one.select(
        "doc_id",
        "uid",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.size("ranked"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(
            F.transform(
                "runs",
                lambda run: F.aggregate(
                    F.filter("ranked", lambda x: x["run"] == run),
                    F.struct(F.lit(-1).alias("first"), F.lit(0).alias("n")),
                    lambda a, x: F.struct(
                        F.when(a["n"] == 0, x["p"]).otherwise(a["first"]).alias("first"), (a["n"] + 1).alias("n")
                    ),
                ),
            ),
            F.array().cast("array<struct<first:int,n:int>>"),
        ).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    )
    return one.drop("copy")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs without contaminated documents (remove="documents"), or without the hit words (remove="spans").

    Columns stay as they are. With "spans", the words of a document that is hit are joined by one
    space, lower-cased, without the hit ones; other documents stay untouched. Null texts and those
    without words are never hit, rows that repeat get the same answer, and empty tables give docs
    as they are. Long texts are searched whole.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    hits = find_contamination(docs, benchmark, window, id_col, text_col).where("n_hit > 0")
    hit, spans = free_name(docs.columns, "_hit_uid"), free_name(docs.columns, "_hit_spans")
    hits = hits.select(F.col("uid").alias(hit), F.col("spans").alias(spans)).dropDuplicates([hit])
    uid = F.xxhash64(F.col(id_col), F.col(text_col))
    if remove == "documents":
        return docs.join(hits, uid == F.col(hit), "left_anti")
    kept = F.filter(
        words_of(F.col(text_col)),
        lambda w, i: ~F.exists(spans, lambda s: (i >= s["first"]) & (i < s["first"] + s["n"])),
    )
    text = F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(F.array_join(kept, " "))
    return docs.join(hits, uid == F.col(hit), "left").withColumn(text_col, text).select(*docs.columns)
