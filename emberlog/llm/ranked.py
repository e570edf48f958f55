"""Ranked lexical search: the best documents of each query, by groups of equal presence masks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import import_path, materialize

# Documents per block of bitmaps, and bytes of query terms that go to every task at once.
BLOCK_DOCS, QUERY_BYTES = 1 << 14, 1 << 22
# Ranks are merged in this many parts per item before they meet.
MERGED = 256
# Fixed values of the score: a document's length counts for 90 of 100.
LENGTH_SHARE, SCALE, STEP, SATURATION = 90, 1_000_000_000, 1000, 8
LAST = np.iinfo(np.int64).max

# Bytes of UTF-8: ASCII letters and digits and all of other characters are of terms, and only A-Z are lowered.
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text, in order and with repeats."""
    return (text or b"").translate(_KEPT).split()


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, terms: the distinct terms of each item; rows of one item are taken together."""
    schema = T.StructType([items.schema[id_col], T.StructField("term", T.BinaryType())])
    schema = T.StructType([T.StructField("item_id", schema[0].dataType), schema[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, x in zip(batch.column(0).to_pylist(), batch.column(1)) for t in set(terms_of(x.as_py()))]
            ids, terms = zip(*rows) if rows else ((), ())
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(terms, pa.binary())], schema.names)

    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, schema).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def in_parts(queries: DataFrame, most: int) -> list[DataFrame]:
    """The queries in parts whose terms have at most `most` bytes, or that are one item."""
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8)
    items, total = queries.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).head()
    n = max(1, -(-total // most))
    while n > 1:
        part = F.pmod(F.xxhash64("item_id", F.lit(n)), F.lit(n))
        largest = queries.groupBy(part).agg(F.sum(size).alias("n"), F.count("*").alias("items")).where("items > 1")
        if (largest.agg(F.max("n")).head()[0] or 0) <= most:
            return [queries.where(part == k) for k in range(n)]
        n = 2 * n
    return [queries] if items else []


def index_documents(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, counts: documents with a term, and how often each term of the vocabulary occurs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)  # at most QUERY_BYTES of terms, or one item
    names = ["doc_id", "n", "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    met = Counter(map(number, words))
                    met.pop(None, None)
                    ids.append(doc_id.as_py())
                    sizes.append(len(words))
                    terms.append(list(met))
                    counts.append(list(met.values()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, sizes, terms, counts), kinds)], names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Block:
    """Some documents: bitmaps of the terms they hold, and what each occurrence adds to a score."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 weights: np.ndarray, n_docs: int, n_words: int):
        self.ids = ids
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n_docs // n_words
        order = np.lexsort((doc, term))
        doc, term, tf = doc[order], term[order], tf[order]
        self.doc, self.adds = doc, weights[term] * (SCALE * tf // (STEP * tf + SATURATION * m[doc]))
        present, starts = np.unique(term, return_index=True)
        self.starts, self.row = np.append(starts, len(term)), np.full(len(weights), -1)
        self.row[present] = np.arange(len(present))
        held = np.zeros((len(present), len(ids)), bool)
        held[self.row[term], doc] = True
        self.bitmaps = np.packbits(held, axis=1)
        self.most = np.maximum.reduceat(self.adds, starts) if len(starts) else np.empty(0, np.int64)

    def _masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold any of some terms, the number of each one's mask, and all masks as rows of bits."""
        held = np.unpackbits(self.bitmaps[rows], axis=1, count=len(self.ids))
        packed = np.packbits(held, axis=0)
        words = np.zeros((len(self.ids), -(-len(packed) // 8) * 8), np.uint8)
        words[:, : len(packed)] = packed.T
        words = words.view(np.uint64)
        docs = np.flatnonzero(words.any(axis=1))
        _, first, number = np.unique(words[docs, 0], return_index=True, return_inverse=True)
        for k in range(1, words.shape[1]):
            inner = np.unique(words[docs, k], return_inverse=True)[1]
            _, first, number = np.unique(number * len(docs) + inner, return_index=True, return_inverse=True)
        return docs, number, held[:, docs[first]]

    def _scores(self, docs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        scores = np.zeros(len(docs), np.int64)
        for row in rows.tolist():
            start, end = self.starts[row], self.starts[row + 1]
            at = np.minimum(np.searchsorted(self.doc[start:end], docs), end - start - 1) + start
            scores += np.where(self.doc[at] == docs, self.adds[at], 0)
        return scores

    def best(self, terms: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of `scores` and `ids`, what is known so far, and this block's documents.

        Documents are grouped by the mask of the terms they hold. Masks come by descending maximum
        score, the sum of the most that each of their terms adds anywhere in the block; when k are
        known and the next maximum is below the least of them, no further mask can matter.
        """
        rows = self.row[terms]
        rows = rows[rows >= 0]
        if not len(rows):
            return scores, ids
        docs, number, masks = self._masks(rows)
        highest = self.most[rows] @ masks
        order = np.argsort(-highest, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place, done, taken = place[number], 0, 16
        while done < len(order):
            least = scores[k - 1] if len(scores) == k else 1
            until = min(int(np.searchsorted(-highest[order], -least, "right")), done + taken)
            if until <= done:
                break
            group = docs[(place >= done) & (place < until)]
            made = self._scores(group, rows)
            good = made >= least
            scores, ids = np.concatenate((scores, made[good])), np.concatenate((ids, self.ids[group[good]]))
            first = np.lexsort((ids, -scores))[:k]
            scores, ids, done, taken = scores[first], ids[first], until, 2 * taken
        return scores, ids


def best_documents(index: DataFrame, items: list[tuple], kind: T.DataType, weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """item_id, task, doc_id, score: of each task's documents the k best for each item.

    A task walks its documents block by block; what it knows of an item so far lets it stop
    earlier in the blocks to come.
    """
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((items, weights))
    schema = T._parse_datatype_string("task long, doc_id long, score long")
    schema = T.StructType([T.StructField("item_id", kind), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        known = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        for batch in batches:
            for at in range(0, len(batch), BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                sizes = np.diff(np.array(part.column("terms").offsets, np.int64))
                block = Block(
                    part.column("doc_id").fill_null(LAST).to_numpy(),
                    part.column("n").to_numpy(),
                    np.repeat(np.arange(len(part)), sizes),
                    part.column("terms").flatten().to_numpy(),
                    part.column("counts").flatten().to_numpy(),
                    weight,
                    n_docs,
                    n_words,
                )
                known = [block.best(terms, k, *best) for (_, terms), best in zip(queries, known)]
        task = TaskContext.get().partitionId()
        for (item, _), (scores, ids) in zip(queries, known):
            if len(ids):
                columns = [
                    pa.array([item] * len(ids), to_arrow_type(kind)),
                    pa.array(np.full(len(ids), task)),
                    pa.array(ids, mask=ids == LAST),
                    pa.array(scores),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    return index.mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The k documents with the highest score above 0 for each item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z
    lowered. A term weighs floor(1000 ln((2N+2)/(2df+1))) and adds, in whole numbers, its weight
    times (10^9 tf) div (1000 tf + 8 m), with m = 10 + (90 n N) div L: N documents that have a
    term, L all terms, n those of the document. Equal scores go by ascending id, null ids last.

    Documents are read once per part of the queries: their terms are counted against the query
    terms, which go to every task in parts of at most `query_bytes` (a single item larger than
    that is a part of its own). Counts of the corpus come from that index, and tasks rank whole
    blocks of it. k rows an item and task are merged, in two steps.

    Null and empty texts, and those without terms, count for nothing and are never found. Items
    without terms, or whose terms occur nowhere, have no rows; rows with the same item id are one
    item. Rows of documents that repeat are documents of their own. Long texts are read whole.
    Other columns are not read. Empty tables give no rows. Ids of documents are integers.
    """
    if k <= 0:
        raise ValueError("k must be a positive integer")
    spark = docs.sparkSession
    import_path(spark)
    kind = items.schema[item_col].dataType
    queries = materialize(query_terms(items, item_col, query_col), "query-terms")
    made = [_rank_part(docs, part, kind, k, id_col, text_col) for part in in_parts(queries, query_bytes)]
    if not made:
        return _no_rows(spark, kind)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _no_rows(spark: SparkSession, kind: T.DataType) -> DataFrame:
    none = spark.range(0).select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "id", "id")
    return none.toDF("item_id", "rank", "doc_id", "score")


def _rank_part(docs: DataFrame, part: DataFrame, kind: T.DataType, k: int, id_col: str, text_col: str) -> DataFrame:
    collected = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in part.toLocalIterator()]
    vocabulary: dict[bytes, int] = {}
    items = [(i, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int64)) for i, terms in collected]
    index = materialize(index_documents(docs, vocabulary, id_col, text_col), "term-counts")
    n_docs, n_words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    if not n_docs:
        return _no_rows(docs.sparkSession, kind)
    met = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in met.toLocalIterator():  # a row per query term
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    found = best_documents(index, items, kind, weights, n_docs, n_words, k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item_id", F.pmod("task", F.lit(MERGED))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return found.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
