"""SimHash near-dedup with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import free_name, import_path, materialize
from emberlog.llm.components import connected_components

# Buckets up to this size are compared all at once, row against the rows after it.
SMALL_BUCKET = 64
# Fingerprints compared in one go; a bucket (65 536 at radius 2) always fits.
CHUNK = 1 << 17
SHINGLES_AT_ONCE = 1 << 15
NONE, FULL = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The SimHash of a text: bit b is set if more than half of the shingles' hashes have it set."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES_AT_ONCE):
        spans = zip(starts[k : k + SHINGLES_AT_ONCE].tolist(), ends[k : k + SHINGLES_AT_ONCE].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in spans], np.dtype("<u8"))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""
    import_path(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


def planes_of(prints: np.ndarray, bits: list[int]) -> list[np.ndarray]:
    """Vertical bit planes: lane i of plane b is bit b of fingerprint i, 64 lanes to a word."""
    n = -(-len(prints) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(prints)] = prints
    return [np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for b in bits]


def within(differences: Iterator[np.ndarray], words: int, radius: int) -> np.ndarray:
    """Lanes whose distance is at most radius, as bits.

    The distances of all lanes are held in carry-save counters, one word per binary digit, that
    take in a plane of differing bits at a time. A lane past the radius is out for good; a block
    of 64 lanes that are all out is abandoned, and the planes still to come skip it.
    """
    digits = (radius + 1).bit_length()
    counts = [np.zeros(words, np.uint64) for _ in range(digits)]
    out = np.zeros(words, np.uint64)
    live = np.arange(words)
    full = FULL
    for step, plane in enumerate(differences):
        carry = plane[live] & ~out[live]
        for c in counts:
            c[live], carry = c[live] ^ carry, c[live] & carry
        reached = np.full(len(live), full)
        for d, c in enumerate(counts):
            reached &= c[live] if (radius + 1) >> d & 1 else ~c[live]
        out[live] |= reached | carry
        if step % 4 == 3:
            live = live[out[live] != full]
            if not len(live):
                break
    return ~out


def _shifted(plane: np.ndarray, by: int) -> np.ndarray:
    """Lane i of the result is lane i + by of the plane; by is under 64."""
    following = np.append(plane[1:], np.uint64(0))
    return plane >> np.uint64(by) | following << np.uint64(64 - by) if by else plane


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def bucket_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that join what is within radius inside each bucket; keys are sorted.

    Rows of small buckets are compared to the 1st, 2nd, ... row after them, all buckets together.
    A larger bucket is walked breadth first, one fingerprint against all not yet reached.
    """
    n = len(prints)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, n))
    size_of_row = np.repeat(sizes, sizes)
    a, b = [], []
    small = np.flatnonzero((size_of_row > 1) & (size_of_row <= SMALL_BUCKET))
    if len(small):
        own, group = prints[small], np.repeat(np.arange(len(sizes)), sizes)[small]
        planes = planes_of(own, list(range(64)))
        for by in range(1, int(size_of_row[small].max())):
            same = np.zeros(len(planes[0]) * 64, np.uint8)
            same[: len(own) - by] = group[:-by] == group[by:]
            if not same.any():
                break
            near = within((p ^ _shifted(p, by) for p in planes), len(planes[0]), radius)
            rows = _lanes(near & np.packbits(same, bitorder="little").view("<u8"), len(own) - by)
            a.append(small[rows])
            b.append(small[rows + by])
    for start, size in zip(starts[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist()):
        own = prints[start : start + size]
        differing = int(np.bitwise_or.reduce(own) & ~np.bitwise_and.reduce(own))
        bits = [i for i in range(64) if differing >> i & 1]
        planes = planes_of(own, bits)
        left = np.packbits(np.arange(len(planes[0]) * 64) < size, bitorder="little").view("<u8").copy()
        for root in range(size):
            if not int(left[root // 64]) >> (root % 64) & 1:
                continue
            left[root // 64] &= ~(np.uint64(1) << np.uint64(root % 64))
            frontier = [root]
            while frontier:
                q = frontier.pop()
                whole = [FULL if int(own[q]) >> bit & 1 else NONE for bit in bits]
                near = left & within((p ^ w for p, w in zip(planes, whole)), len(left), radius)
                rows = _lanes(near, size)
                left &= ~near
                frontier += rows.tolist()
                a.append(np.full(len(rows), start + root))
                b.append(start + rows)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def similar_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that leave connected what is within radius.

    Two fingerprints that differ in `radius` bits agree in all but `radius` of their eight bytes.
    So each one goes into a bucket for every choice of that many bytes to leave out, keyed by
    what is left. A bucket has 256 to the power of radius members at most, since fingerprints
    differ: no bucket can grow with the corpus.
    """
    import_path(prints.sparkSession)
    masks = []
    for left_out in combinations(range(8), radius):
        mask = sum(0xFF << 8 * byte for byte in range(8) if byte not in left_out)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    dealt = prints.select("fp", F.explode(keys).alias("b")).select("fp", "b.k", "b.key")

    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        k, key = table["k"].to_numpy().astype(np.int64), table["key"].to_numpy()
        fp = table["fp"].to_numpy().view(np.uint64)
        change = np.append(False, (k[1:] != k[:-1]) | (key[1:] != key[:-1]))
        a, b = bucket_links(np.cumsum(change), fp, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < CHUNK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            k, key = whole.column("k").to_numpy(), whole.column("key").to_numpy()
            last = np.flatnonzero((k != k[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield compare([whole.slice(0, cut)])
                held = [whole.slice(cut)]
        if held:
            yield compare(held)

    dealt = dealt.repartition("k", "key").sortWithinPartitions("k", "key")
    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(
    docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id.

    Fingerprints are taken over all shingles of lower-cased (A-Z) words. Documents are linked if
    their fingerprints differ in `radius` bits or fewer; component_id is the smallest doc_id that
    links lead to. Equal fingerprints are one before any comparison, so copies cost nothing.

    Null text and text without words have fingerprint zero, linked like any other. A text with
    fewer words than a shingle is one shingle. Repeated rows and equal ids are compared like
    others and get the same answer. Null ids count for no minimum; a component with no other id
    has a null component_id. Other columns are not read. Without documents no rows come.
    """
    if not 0 <= radius <= 3:
        raise ValueError(f"radius is 0 to 3, not {radius}: larger ones need more bytes than are left to agree")
    printed = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    links = materialize(similar_links(distinct.select("fp"), radius), "links")
    found = materialize(connected_components(links, "fingerprint"), "fingerprint-components")
    linked = found.join(distinct, F.col("node") == F.col("fp"))
    least = materialize(linked.groupBy("label").agg(F.min("least_id").alias("component_id")), "component-ids")
    of_print = found.join(least, "label").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    told = distinct.join(of_print, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id")
    )
    return printed.join(materialize(told, "fingerprint-ids"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; columns as they are.

    Rows with a null id go if their component has an id, and stay otherwise.
    """
    kept = near_copies(docs, id_col=id_col, **settings).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept_id = free_name(docs.columns, "_kept_id")
    kept = kept.select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
