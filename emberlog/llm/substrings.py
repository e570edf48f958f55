"""Substring dedup by super-k-mer partitioning: repeated windows of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.windows import Units, range_hashes, without_repeats

GRAM = 8


def _by_hash(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hashes(data, first, end)


def drop_repeated_words(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans, kept.

    A word goes if a window of `window` words that covers it also starts in a document with a
    smaller id; windows are judged on the input. kept are the other words joined by one space,
    spans the removed runs as (first, n) in words. Consecutive windows that share a minimiser
    travel as one packed string to its bucket, where the windows are sorted and equal ones found.

    Null text has no words. A null id comes after all others. Rows with equal ids do not remove
    each other's words. Texts shorter than a window stay. Other columns are not read, and no rows
    give no rows. Ids are integers.
    """
    units = Units(window, min(GRAM, window), words=True, same_document=False)
    made = without_repeats(docs, units, _by_hash, id_col, text_col)
    return made.withColumnRenamed("n_units", "n_words").withColumn("kept", F.decode("kept", "UTF-8"))
