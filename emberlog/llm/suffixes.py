"""Suffix-array dedup by bucket-pointer refinement: repeated strings of bytes."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from emberlog.llm.windows import Units, range_hashes, without_repeats

GRAM = 20


def refined_buckets(data: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Numbers for the suffixes at `first`, equal where their first `length` bytes are equal.

    Suffixes begin in buckets of their q-grams, a quarter of the length. A bucket is refined by
    sorting its suffixes on the buckets that the suffixes q further on are in, which tells twice
    the length; the new buckets serve the next round the same way. Suffixes that are alone in
    their bucket are settled and take no part in later rounds.
    """
    q = -(-length // 4)
    n = len(data) - q + 1
    suffixes = np.arange(max(n, 0))
    bucket = np.zeros(len(data), np.int64)
    if n > 0:
        bucket[:n] = np.unique(range_hashes(data, suffixes, suffixes + q), return_inverse=True)[1]
    depth, numbers = q, len(data)
    while depth < length:
        step = min(depth, length - depth)
        if depth + step >= length:
            suffixes = first
        suffixes = suffixes[suffixes + step < len(data)]
        sizes = np.bincount(bucket[suffixes], minlength=1)
        suffixes = suffixes[sizes[bucket[suffixes]] > 1]
        pairs = bucket[suffixes] * numbers + bucket[suffixes + step]
        bucket = bucket.copy()
        # Settled suffixes keep their number, which no new one equals.
        bucket[suffixes] = numbers + np.unique(pairs, return_inverse=True)[1]
        numbers += len(suffixes)
        depth += step
    return bucket[first]


def _refined(length: int, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return refined_buckets(data, first, length)


def drop_repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans, kept (binary).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document
    with a smaller id, or earlier in the same one. Strings are judged on the input and may
    overlap; none crosses documents. kept are the other bytes, which may cut a character, spans
    the removed runs as (first, n) in bytes. The suffixes of each bucket's strings are sorted by
    bucket-pointer refinement, as deep as `length`.

    Null text is empty. A null id comes after all others; rows with equal ids and texts are one
    document and do not remove each other. Texts shorter than `length` stay. Other columns are
    not read, and no rows give no rows. Ids are integers.
    """
    units = Units(length, min(GRAM, length), words=False, same_document=True)
    made = without_repeats(docs, units, partial(_refined, length), id_col, text_col)
    return made.withColumnRenamed("n_units", "n_bytes")
