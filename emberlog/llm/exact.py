"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import free_name, materialize, one_space

# A chunk ends after the first clause mark and space at or beyond 512 characters, so that an
# insertion moves no cut but those near it; a text without such marks is cut every 8192.
CHUNK = r"(?s).{510,8190}?[.!?,;:] |.{1,8192}"


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def chunks_of(text: Column) -> Column:
    """The chunks of a text; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def doubtful_chunks(texts: DataFrame, identify: Callable[[Column], Column]) -> DataFrame:
    """Identifiers that stand for more than one chunk, found by comparing the chunks themselves.

    The dictionary of chunks is built with map-side combining, so a chunk that a third of all
    documents share leaves each task once. This is the only place where text is moved.
    """
    chunks = texts.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    dictionary = chunks.groupBy(identify(F.col("chunk")).alias("id"), "chunk").agg(F.lit(1).alias("one"))
    return dictionary.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    identify: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal if identical after each run of ASCII white space became one space. A text is
    cut into content-defined chunks and stands as its recipe, the ordered list of chunk
    identifiers. Identifiers are verified against the chunk texts: one that two different chunks
    share makes the recipes that use it count with their whole text. Recipes are then compared
    in place of texts.

    Null text counts as empty; empty texts equal each other. Rows that repeat a doc_id are copies
    like any other, and of those the row with the smallest id stays with each of its repeats. A
    null doc_id comes after all others: it stays only if its whole group has none. Columns besides
    the two named are not read, so their names cannot clash. No rows in, no rows out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), one_space(F.col(text_col)).alias("text"))
    doubtful = doubtful_chunks(texts, identify).agg(F.collect_set("id").alias("ids")).scalar()
    identifiers = F.transform(chunks_of(F.col("text")), identify)
    recipes = materialize(
        texts.select("doc_id", "text", identifiers.alias("chunk_ids")).select(
            "doc_id",
            F.array_join(F.transform("chunk_ids", F.hex), "").alias("listed"),
            F.when(F.arrays_overlap("chunk_ids", doubtful), F.col("text")).alias("whole"),
            F.sha2("text", 256).alias("text_sha256"),
            F.size("chunk_ids").cast("long").alias("n_chunks"),
        ).withColumn("listed", F.unhex("listed")),
        "recipes",
    )
    groups = materialize(
        recipes.groupBy("listed", F.coalesce("whole", F.lit("")).alias("whole"))
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "recipe-groups",
    )
    # Both sides are plain scans, so a hot group's partition can be split at run time.
    groups = groups.withColumnsRenamed({"listed": "g_listed", "whole": "g_whole"})
    same = (F.col("listed") == F.col("g_listed")) & (F.coalesce("whole", F.lit("")) == F.col("g_whole"))
    joined = recipes.join(groups, same, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies; columns as they were, whatever they are called.

    Of equal texts the row with the smallest id stays, once if it is there repeatedly. Rows with a
    null id stay if no row with an id equals them, also once. Null and empty texts are equal. Long
    texts are compared by their chunks. Without documents no rows come.
    """
    kept_id, same = free_name(docs.columns, "_kept_id"), free_name(docs.columns, "_same")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    kept = docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    return kept.withColumn(same, F.md5(one_space(F.col(text_col)))).dropDuplicates([id_col, same]).drop(same)
