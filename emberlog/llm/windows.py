"""Stretches of a fixed number of units, words or bytes, that occur more than once in a corpus.

Both substring operators find them in the same steps. Only what two tasks must compare travels:

1. Every window has a minimiser, the least hash of the m-grams inside it. Consecutive windows that
   share it form a super-k-mer. Its description (minimiser, document, position, length) is
   shuffled, without text; equal windows have equal minimisers, so where a minimiser occurs once
   nothing can repeat.
2. Super-k-mers with a minimiser that occurs again are cut out of their texts, one packed string
   each, and travel to the bucket of their minimiser, where equal windows are found exactly.
3. What is to be removed goes back to its document as spans.

A minimiser that many windows share would make a hot bucket. Its strings are dealt by the hash of
the whole string instead, where copies meet, and the windows of those that are left, each first of
its kind in its task, are dealt once more by the hash of the whole window. Equal strings also meet
inside each task before anything is shuffled, so that a passage in a third of all documents
leaves each task about once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import import_path, materialize

# Windows, or super-k-mers, sharing a minimiser above which they are not dealt by it.
HOT_WINDOWS, HOT_STRINGS = 100_000, 4096
# Windows of one super-k-mer at most; longer runs (of one character, say) are cut.
LONGEST_RUN = 4096
PLACE_BITS = LONGEST_RUN.bit_length()
# Windows hashed at once, descriptions held for combining, bytes of strings held and compared.
WINDOWS_AT_ONCE, DESCRIBED, CUT_BYTES, BUCKET_BYTES = 1 << 16, 1 << 18, 1 << 24, 1 << 19
LAST = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Units:
    """What a window is made of: `window` units, with minimisers over `gram` units."""

    window: int
    gram: int
    words: bool
    # Of equal windows the first stays; whether a later one in the same document counts as later.
    same_document: bool

    def split(self, text: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text in units: bytes, and where each unit begins and ends."""
        data = text or b""
        if not self.words:
            at = np.arange(len(data) + 1)
            return data, at[:-1], at[1:]
        data = b" ".join(data.split())
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        n = bool(data)
        return data, np.concatenate(([0] * n, gaps + 1)), np.concatenate((gaps, [len(data)] * n))


class _Powers:
    """Powers of the hash's base and of its inverse, grown as needed."""

    base = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.base) < n:
            size = 1 << (n - 1).bit_length()
            for name, value in (("base", BASE), ("inverse", BASE_INVERSE)):
                steps = np.full(size, value, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.base[:n], cls.inverse[:n]


def range_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[first:end], equal for equal bytes wherever they stand."""
    base, inverse = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * base[:-1], out=sums[1:])
    h = (sums[end] - sums[first]) * inverse[first]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    span, least, n = 1, values, len(values) - width + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n])


def _several(hashes: np.ndarray, least: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which minimisers stand at more than one place of the text.

    A gram is some window's minimiser if it equals the greatest of the leasts around it.
    """
    width = len(hashes) - len(least) + 1
    around = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    chosen = hashes[~sliding_least(~around, width) == hashes]
    values, counts = np.unique(chosen, return_counts=True)
    return counts[np.searchsorted(values, keys)] > 1


def super_kmers(units: Units, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window, number of windows and weight of each super-k-mer of a text, in order.

    The weight is 2 if the minimiser alone may stand for a repeat, inside one document.
    """
    data, starts, ends = units.split(text)
    total = len(starts) - units.window + 1
    keys, firsts, sizes, weights = [], [], [], []
    array = np.frombuffer(data, np.uint8)
    for w in range(0, max(total, 0), WINDOWS_AT_ONCE):
        n = min(WINDOWS_AT_ONCE, total - w)
        a, b = starts[w : w + n + units.window - 1], ends[w : w + n + units.window - 1]
        grams = len(a) - units.gram + 1
        offset = a[0]
        hashes = range_hashes(array[offset : b[-1]], a[:grams] - offset, b[units.gram - 1 :] - offset)
        least = sliding_least(hashes, units.window - units.gram + 1)
        at = np.flatnonzero(np.append(True, (least[1:] != least[:-1])))
        size = np.diff(np.append(at, n))
        if size.max() > LONGEST_RUN:
            at = np.concatenate([np.arange(s, s + k, LONGEST_RUN) for s, k in zip(at, size)])
            size = np.diff(np.append(at, n))
        keys.append(least[at])
        firsts.append(at + w)
        sizes.append(size)
        several = _several(hashes, least, least[at]) if units.same_document else np.zeros(len(at), bool)
        weights.append(1 + several.astype(np.int32))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(sizes), np.concatenate(weights)


def _record(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


STRINGS = "key long, doc long, uid long, first int, n int, hot boolean, packed binary"
STRING_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())


def _strings(*columns) -> pa.RecordBatch:
    return _record([c.split()[0] for c in STRINGS.split(", ")], *[pa.array(c, t) for c, t in zip(columns, STRING_TYPES)])


def _string_hash(packed: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)


def describe(own: DataFrame, units: Units) -> DataFrame:
    """key, uid, first, n, weight: the super-k-mers of every text.

    A minimiser met several times in a task is known to repeat: one row speaks for all of them
    (weight, how many) and the others, of weight 0, need no further comparison.
    """
    names = ["key", "uid", "first", "n", "weight"]

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        key, uid, first, n, own = (np.concatenate(c) for c in zip(*parts))
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        weight = np.zeros(len(key), np.int32)
        weight[at] = np.bincount(back, own)
        return _record(names, key.view(np.int64), uid, first.astype(np.int32), n.astype(np.int32), weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for uid, text in zip(batch.column(0), batch.column(1)):
                key, first, n, weight = super_kmers(units, text.as_py())
                if len(key):
                    parts.append((key, np.full(len(key), uid.as_py(), np.int64), first, n, weight))
                    held += len(key)
                if held >= DESCRIBED:
                    yield combined(parts)
                    parts, held = [], 0
        if parts:
            yield combined(parts)

    return own.select("uid", F.col("text").cast("binary")).mapInArrow(
        run, "key long, uid long, first int, n int, weight int"
    )


def repeating(described: DataFrame) -> DataFrame:
    """The super-k-mers whose minimiser occurs more than once: key, uid, first, n."""
    known = F.col("weight") == 0
    dealt = F.when(known, F.xxhash64("key", "uid", "first")).otherwise(F.col("key"))
    # A place is one number in the shuffle: rows of fewer columns are smaller.
    place = F.shiftleft(F.col("first").cast("long"), PLACE_BITS).bitwiseOR(F.col("n"))
    met = F.sum("weight").over(Window.partitionBy("dealt"))
    counted = described.select("key", "uid", place.alias("place"), "weight", dealt.alias("dealt")).withColumn("met", met)
    first = F.shiftright("place", PLACE_BITS).cast("int").alias("first")
    n = F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("n")
    return counted.where(known | (F.col("met") > 1)).select("key", "uid", first, n)


def cut_out(joined: DataFrame, units: Units) -> DataFrame:
    """Packed strings and spans already known, as rows of STRINGS; a span has no string.

    joined holds uid, doc (the document's place in the order), text and cuts. Equal strings meet
    here: the one of the first document goes on, the others are spans to remove at once, a row
    for those that follow one another.
    """
    def flush(held: list[tuple]) -> pa.RecordBatch:
        seen: dict[bytes, tuple[int, int]] = {}
        rows: list[tuple] = []

        def repeats(packed: bytes, doc: int, first: int) -> bool:
            met = seen.setdefault(packed, (doc, first))
            return met[0] < doc or (units.same_document and met[0] == doc and met[1] < first)

        for doc, uid, data, starts, ends, cuts in sorted(held, key=lambda d: d[:2]):
            since = until = -1  # the span that goes on
            for first, n, key, hot in cuts:
                n = min(n, len(starts) - units.window + 1 - first)
                if n <= 0:
                    continue
                packed = data[starts[first] : ends[first + n + units.window - 2]]
                if repeats(packed, doc, first):
                    if first == until:
                        rows.pop()
                    else:
                        since = first
                    until = first + n
                    rows.append((uid ^ since, doc, uid, since, until - since, False, None))
                else:
                    until = -1
                    rows.append((_string_hash(packed) if hot else key, doc, uid, first, n, hot, packed))
        return _strings(*(zip(*rows) if rows else [()] * len(STRING_TYPES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for uid, doc, text, cuts in zip(*(batch.column(c) for c in ("uid", "doc", "text", "cuts"))):
                data, starts, ends = units.split(text.as_py())
                listed = sorted({tuple(c.values()) for c in cuts.as_py()})
                held.append((doc.as_py(), uid.as_py(), data, starts, ends, listed))
                size += len(data)
                if size >= CUT_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return joined.mapInArrow(run, STRINGS)


Group = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _spans(doc: np.ndarray, uid: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of STRINGS that say what is to be removed."""
    m = len(doc)
    return _strings(uid ^ first, doc, uid, first, n, np.zeros(m, bool), pa.nulls(m, pa.binary()))


def settled(
    units: Units, rows: pa.Table, doc: np.ndarray, n: np.ndarray, hot: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which rows, in the order of documents, are copies of an earlier one's, and which are to be compared.

    All windows of a string that an earlier document has too repeat. Of the others, one alone in
    its bucket meets no other, and repeats windows of its own only if it holds the bucket's
    minimiser twice. Hot rows are all compared, as one window may be in several of their buckets.
    """
    codes = pa.compute.dictionary_encode(rows["packed"].combine_chunks()).indices.to_numpy()
    lead = np.empty(len(n), np.int64)
    lead[codes[::-1]] = np.arange(len(n))[::-1]
    copy = doc > doc[lead[codes]]
    bucket = np.unique(rows["key"].to_numpy(), return_inverse=True)[1]
    alone = ~copy & ~hot & (np.bincount(bucket[~copy], minlength=len(n))[bucket] == 1)
    if units.same_document:
        own = np.flatnonzero(alone & (n > 1))
        alone[own[_twice(units, rows.take(pa.array(own)))]] = False
    return np.flatnonzero(copy), np.flatnonzero(~copy & ~alone)


def _twice(units: Units, rows: pa.Table) -> np.ndarray:
    """Which strings hold the gram with their key's hash at more than one place, for units of bytes."""
    strings = rows["packed"].to_pylist()
    if not strings:
        return np.zeros(0, bool)
    array = np.frombuffer(b"\n".join(strings), np.uint8)
    ends = np.cumsum([len(s) + 1 for s in strings])
    at = np.arange(len(array) - units.gram + 1)
    hashes = range_hashes(array, at, at + units.gram)
    row = np.searchsorted(ends, at, "right")
    found = hashes == rows["key"].to_numpy().view(np.uint64)[row]
    return np.bincount(row[found], minlength=len(strings)) > 1


def repeated_spans(units: Units, group: Group, rows: pa.Table) -> tuple[pa.RecordBatch, pa.RecordBatch, np.ndarray]:
    """Spans of the windows that repeat an earlier one, the other windows of hot rows one by one,
    and which rows hold a window that is not repeated.

    `group` numbers windows so that unequal numbers mean unequal windows. Windows that repeat in
    step are compared in one piece, byte by byte; should a piece differ, its windows are looked up
    by their bytes.
    """
    rows = rows.sort_by([("doc", "ascending"), ("uid", "ascending"), ("first", "ascending")])
    doc, uid, first, n = (rows[c].to_numpy().astype(np.int64) for c in ("doc", "uid", "first", "n"))
    hot = rows["hot"].to_numpy()
    copies, open_ = settled(units, rows, doc, n, hot)
    copied = _spans(*(c[copies] for c in (doc, uid, first, n)))
    holds = np.ones(len(n), bool)
    holds[copies] = False
    if not len(open_):
        return copied, _strings(*[()] * len(STRING_TYPES)), holds
    doc, uid, first, n, hot = (c[open_] for c in (doc, uid, first, n, hot))
    strings = rows["packed"].take(pa.array(open_)).to_pylist()
    data = b"\n".join(strings)
    array = np.frombuffer(data, np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    begins = np.cumsum(np.append(0, sizes[:-1] + 1))
    if units.words:
        gaps = np.flatnonzero((array == 32) | (array == 10))
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(array))
        unit_of_row = np.searchsorted(starts, begins)
    else:
        starts, ends, unit_of_row = np.arange(len(array)), np.arange(1, len(array) + 1), begins
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    unit = unit_of_row[row] + step
    a, b = starts[unit], ends[unit + units.window - 1]
    ids = group(array, a, b)
    order = np.argsort(ids, kind="stable")
    fresh = np.append(True, ids[order][1:] != ids[order][:-1])
    leader = np.empty(len(ids), np.int64)
    leader[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    place = first[row] + step

    def later(i, f):
        own, met = doc[row[i]], doc[row[f]]
        return (met < own) | (units.same_document & (met == own) & (place[f] < place[i]))

    gone = np.zeros(len(ids), bool)
    other = np.flatnonzero(leader != np.arange(len(ids)))
    if len(other):
        f = leader[other]
        together = (np.diff(other) == 1) & (np.diff(row[other]) == 0) & (np.diff(f) == 1) & (np.diff(row[f]) == 0)
        at = np.flatnonzero(np.append(True, ~together))
        until = np.append(at[1:], len(other))
        gone[other] = later(other, f)
        for s, e in zip(at.tolist(), until.tolist()):
            if data[a[other[s]] : b[other[e - 1]]] != data[a[f[s]] : b[f[e - 1]]]:
                for k in other[s:e].tolist():
                    own = data[a[k] : b[k]]
                    same = next(x for x in np.flatnonzero(ids == ids[k]).tolist() if data[a[x] : b[x]] == own)
                    gone[k] = later(k, same)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))) if len(gone) else np.empty(0, np.int64)
    # Runs of repeated windows, cut where a row ends.
    cut = np.unique(np.concatenate((edges[::2], np.flatnonzero(gone & (step == 0)))))
    stop = np.minimum(np.append(cut[1:], len(gone)), edges[1::2][np.searchsorted(edges[1::2], cut, "right")]) if len(cut) else cut
    spans = pa.concat_batches([copied, _spans(doc[row[cut]], uid[row[cut]], place[cut], stop - cut)])
    on = np.flatnonzero(~gone & hot[row])
    keys = range_hashes(array, a[on], b[on]).view(np.int64) if len(on) else np.empty(0, np.int64)
    single = [data[s:e] for s, e in zip(a[on].tolist(), b[on].tolist())]
    singles = _strings(keys, doc[row[on]], uid[row[on]], place[on], np.ones(len(on), np.int32), np.zeros(len(on), bool), single)
    holds[open_] = False
    holds[open_[row[~gone]]] = True
    return spans, singles, holds


def compare_buckets(cut: DataFrame, units: Units, group: Group) -> DataFrame:
    """Spans to remove and what is still to be compared, from packed strings dealt to buckets.

    A task walks its buckets in order, some at a time. Of a bucket that is larger than that, the
    strings that hold a window not yet met go along to the next part, so memory is bounded by what
    differs inside one bucket.
    """

    def length(table: pa.Table) -> int:
        return pa.compute.sum(pa.compute.binary_length(table["packed"])).as_py() or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, carried = [], 0, 0
        for batch in batches:
            known = pa.compute.is_null(batch.column("packed"))
            yield batch.filter(known)
            table = pa.Table.from_batches([batch.filter(pa.compute.invert(known))])
            if not len(table):
                continue
            # Parts of bounded size, whatever the size of a batch.
            ends = np.cumsum(pa.compute.binary_length(table["packed"]).to_numpy().astype(np.int64))
            marks = np.searchsorted(ends, np.arange(BUCKET_BYTES, ends[-1] + BUCKET_BYTES, BUCKET_BYTES))
            at = 0
            for until in np.unique(np.minimum(marks + 1, len(table))).tolist():
                part = table.slice(at, until - at)
                at = until
                held.append(part)
                size += length(part)
                if size - carried < BUCKET_BYTES:
                    continue
                whole = pa.concat_tables(held)
                key = whole["key"].to_numpy()
                before = np.flatnonzero(key != key[-1])
                split = int(before[-1]) + 1 if len(before) else 0
                if split:
                    yield from repeated_spans(units, group, whole.slice(0, split))[:2]
                    last = whole.slice(split)
                else:  # hot rows wait for the end of their bucket: they are told one by one only once
                    spans, singles, holds = repeated_spans(units, group, whole)
                    yield spans
                    order = [("doc", "ascending"), ("uid", "ascending"), ("first", "ascending")]
                    last = whole.sort_by(order).filter(pa.array(holds))
                held = [last]
                size = carried = length(last)
        whole = pa.concat_tables(held) if held else None
        if whole is not None and len(whole):
            yield from repeated_spans(units, group, whole)[:2]

    dealt = cut.repartition("key").sortWithinPartitions("key", "doc", "uid", "first")
    return dealt.mapInArrow(run, STRINGS)


def remove_spans(joined: DataFrame, units: Units, kind: T.DataType) -> DataFrame:
    """doc_id, n_units, n_removed, spans, kept from doc_id, doc, text and the spans to remove."""
    names = ["doc_id", "n_units", "n_removed", "spans", "kept"]
    span = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))

    def one(text: bytes | None, doc: int, spans: list[dict] | None) -> tuple:
        data, starts, ends = units.split(text)
        own = sorted({(s["first"], s["end"]) for s in spans or () if s["doc"] == doc})
        if not own:
            return len(starts), 0, [], data
        ticks = np.zeros(len(starts) + 1, np.int64)
        np.add.at(ticks, [s for s, _ in own], 1)
        np.add.at(ticks, [e for _, e in own], -1)
        gone = np.cumsum(ticks[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        runs = [{"first": int(s), "n": int(e - s)} for s, e in zip(edges[::2], edges[1::2])]
        stay = np.flatnonzero(np.diff(np.concatenate(([1], gone.view(np.int8), [1]))))
        parts = [data[starts[s] : ends[e - 1]] for s, e in zip(stay[::2], stay[1::2])]
        return len(starts), int(gone.sum()), runs, (b" " if units.words else b"").join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text"), batch.column("doc"), batch.column("spans"))
            made = [one(t.as_py(), d.as_py(), s.as_py()) for t, d, s in rows]
            n, gone, runs, kept = zip(*made) if made else [()] * 4
            yield _record(
                names,
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(runs, span),
                pa.array(kept, pa.binary()),
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("n_units", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T._parse_datatype_string("array<struct<first:long,n:long>>")),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    return joined.select("doc_id", "doc", "text", "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, units: Units, group: Group, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_units, n_removed, spans and kept of each row of docs.

    Both joins take documents by the same key, so they are shuffled once for the two of them.
    """
    import_path(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    own = own.select(
        F.xxhash64("doc_id", "text").alias("uid"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        "doc_id",
        "text",
    )
    again = materialize(repeating(describe(own, units)), "super-kmers")
    met = again.groupBy("key").agg(F.sum("n").alias("windows"), F.count("*").alias("strings"))
    hot = met.where((F.col("windows") > HOT_WINDOWS) | (F.col("strings") > HOT_STRINGS))
    hot = materialize(hot.select("key", F.lit(True).alias("hot")), "hot-minimisers")
    cuts = again.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cuts = cuts.groupBy("uid").agg(F.collect_list(F.struct("first", "n", "key", "hot")).alias("cuts"))
    told = compare_buckets(cut_out(own.join(cuts, "uid"), units), units, group)
    told = compare_buckets(told, units, group).where("packed is null")
    end = (F.col("first") + F.col("n") + (units.window - 1)).alias("end")
    spans = told.groupBy("uid").agg(F.collect_list(F.struct("doc", "first", end)).alias("spans"))
    return remove_spans(own.join(spans, "uid", "left"), units, docs.schema[id_col].dataType)
