"""Alignment of the ids that two tokenizers give the same bytes."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import import_path, materialize

# Links after which a block is closed, at the end of a document.
BLOCK_LINKS = 1 << 17
# Aligned chunks in each of the two generations that a worker keeps; those not met go.
MOST_CHUNKS = 200_000
# Characters of text that are aligned together, a longer text alone, and new chunks that are joined to one text.
TOGETHER, JOINED = 1 << 20, 1 << 10
# Pairs of ids up to which their counts go to every task, 17 bytes each; beyond that they are joined.
MOST_PAIRS = 2_000_000
SPACE_MARK = "▁"
# White space next to a space, or at either end of a text.
LOOSE = re.compile(r"\s | \s|\A\s|\s\Z")


class ByteLevelTokenizer:
    """A byte-level tokenizer of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        shown = {c: b for b, c in enumerate(shown_bytes())}
        self.space = shown_bytes()[0x20]
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            # A token with a character that stands for no byte is not byte-level; it matches nothing.
            self.bytes[i] = bytes(map(shown.get, token)) if all(c in shown for c in token) else b"\xff" + token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, each after a space."""
        return [m.ids for m in self.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]

    def encode_chunks(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The chunks, words of ASCII letters first, and the ids of them all joined by spaces.

        Such a word with its space is one piece, which goes straight to the merges.
        """
        words, others, ids = [], [], []
        for c in chunks:
            (words if c.isascii() and c.isalpha() else others).append(c)
        merged = self.tokenizer.model.tokenize
        for word in words:
            ids += [t.id for t in merged(self.space + word)]
        if others:
            ids += self.encode([" ".join(others)])[0]
        return words + others, ids

    def cuts_at_spaces(self) -> bool:
        """Whether a single space always begins a piece: so it does in the byte-level pattern."""
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        return not told["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


class PieceTokenizer:
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            own = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()
            self.bytes.append(own)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, each after the space that the model puts there."""
        return [self.model.encode(t) for t in texts]  # a list at once would start threads

    def cuts_at_spaces(self) -> bool:
        """Whether no piece goes on over a space: merges inside it then cannot reach past it."""
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        return not any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in pieces)


def shown_bytes() -> list[str]:
    """The character that byte-level vocabularies show for each byte.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from
    U+0100 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = (chr(256 + k) for k in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


# What a text or a chunk of it comes to: ids of a and b, ids of either in each group in turn (four
# bytes each), and the linked pairs (eight bytes each).
Aligned = tuple[bytes, bytes, bytes, bytes]


def chunks_of(text: str) -> list[str]:
    """A text cut at each space that stands between two other characters, without those spaces.

    White space of any kind next to a space keeps it inside a chunk.
    """
    pieces = text.split(" ")
    if not LOOSE.search(text):
        return pieces
    chunks, open_ = [], False
    for piece in pieces:
        if chunks and (open_ or not piece or piece[0].isspace()):
            chunks[-1] += f" {piece}"
        else:
            chunks.append(piece)
        open_ = not piece or piece[-1].isspace()
    return chunks


class Aligner:
    """Two tokenizers with the bytes of their ids, and the alignment of texts and of their chunks.

    Where both tokenizers cut at single spaces, a text's alignment is that of its chunks in order,
    and a chunk that is met again need not be aligned again.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevelTokenizer(path_a), PieceTokenizer(path_b)
        self.length_a, self.length_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # Ids as text, with what follows them: a comma inside a slice, and what ends it.
        self.text_a, self.text_b = (
            np.array([f"{i}{mark}" for mark in (",", end) for i in range(len(t.bytes))], object)
            for t, end in ((self.a, "|"), (self.b, ";"))
        )
        self.in_chunks = self.a.cuts_at_spaces() and self.b.cuts_at_spaces()
        self.forget()

    def forget(self) -> None:
        """Let go of the chunks that are kept."""
        self.recent: dict[str, Aligned | bool] = {}
        self.older: dict[str, Aligned | bool] = {}

    def __call__(self, text: str) -> Aligned | None:
        """The alignment of a text; None where an id list's bytes are not those of the text."""
        return self.together([text])[0]

    def together(self, texts: list[str]) -> list[Aligned | None]:
        """The alignment of each text; chunks that are new to all of them are aligned once."""
        if not self.in_chunks:
            return [made or None for made in self.align(texts)]
        if len(self.recent) > MOST_CHUNKS:
            self.older, self.recent = self.recent, {}
        cut = list(map(chunks_of, texts))
        self._learn(set().union(*cut) - self.recent.keys())
        told = []
        for chunks in cut:
            parts = list(map(self.recent.__getitem__, chunks))
            told.append(None if False in parts else tuple(map(b"".join, zip(*parts))))
        return told

    def _learn(self, missing: set[str]) -> None:
        """Take chunks from the older generation or align them, those without white space many in one text.

        A text that has no alignment is halved, so that one chunk that has none holds up few others.
        """
        known = {c: self.older[c] for c in missing if c in self.older}
        self.recent.update(known)
        new = [c for c in missing if c not in known]
        plain = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        while groups:
            group = groups.pop()
            made = self._align_together(group)
            self.recent.update(made)
            if not made and len(group) > 16:
                groups += group[: len(group) // 2], group[len(group) // 2 :]
        rest = [c for c in new if c not in self.recent]
        self.recent.update(zip(rest, self.align(rest)))

    def _align_together(self, chunks: list[str]) -> dict[str, Aligned]:
        """Alignments of chunks from that of all of them in one text; none if it has none."""
        chunks, ids_a = self.a.encode_chunks(chunks)
        text = " ".join(chunks)
        whole = self._aligned(text, ids_a, self.b.encode([text])[0])
        if not whole:
            return {}
        a, b = (np.frombuffer(x, "<u4") for x in whole[:2])
        cuts = np.frombuffer(whole[2], "<u4").reshape(-1, 2)
        until = np.cumsum([len(c.encode()) + 1 for c in chunks])
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        tokens_a, tokens_b = np.searchsorted(ends_a, until) + 1, np.searchsorted(ends_b, until) + 1
        if (ends_a[tokens_a - 1] != until).any() or (ends_b[tokens_b - 1] != until).any():
            return {}
        groups = np.searchsorted(np.cumsum(cuts[:, 0]), tokens_a) + 1
        # A group of p and q tokens has p + q - 1 links, in the order of groups.
        links = np.cumsum(cuts.sum(axis=1, dtype=np.int64) - 1)[groups - 1]
        edges = [[0, *(n * size).tolist()] for n, size in ((tokens_a, 4), (tokens_b, 4), (groups, 8), (links, 8))]
        columns = [[x[s:e] for s, e in zip(edge, edge[1:])] for x, edge in zip(whole, edges)]
        return dict(zip(chunks, zip(*columns)))

    def align(self, texts: list[str]) -> list[Aligned | bool]:
        """The alignment of whole texts; False where bytes differ."""
        return list(map(self._aligned, texts, self.a.encode(texts), self.b.encode(texts)))

    def _aligned(self, text: str, ids_a: list[int], ids_b: list[int]) -> Aligned | bool:
        data = f" {text}".encode()
        if any(b"".join(map(t.bytes.__getitem__, ids)) != data for t, ids in ((self.a, ids_a), (self.b, ids_b))):
            return False
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        n_a, n_b = self.slices(a, b)
        at_a, at_b = self.links(a, b, n_a, n_b)
        cuts = np.column_stack((n_a, n_b)).astype("<u4").tobytes()
        return a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), cuts, _code(a[at_a], b[at_b]).tobytes()

    def slices(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids of either list each group holds.

        Groups end where tokens of both end: at the ends that both dictionaries, from an end to
        the number of tokens up to it, have as a key.
        """
        upto_a = dict(zip(np.cumsum(self.length_a[ids_a]).tolist(), range(1, len(ids_a) + 1)))
        upto_b = dict(zip(np.cumsum(self.length_b[ids_b]).tolist(), range(1, len(ids_b) + 1)))
        common = sorted(upto_a.keys() & upto_b.keys())
        cuts = (np.fromiter(map(upto.__getitem__, common), np.int64, len(common)) for upto in (upto_a, upto_b))
        n_a, n_b = (np.diff(c, prepend=0) for c in cuts)
        return n_a, n_b

    def links(self, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in both lists of every pair of tokens whose bytes overlap, slice by slice.

        In a slice with one token on a side that token is linked to all others; the rest are
        walked from end to end. Links come in order.
        """
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        plain = (n_a == 1) | (n_b == 1)
        size = np.where(plain, np.maximum(n_a, n_b), 0)
        group = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        at_a = first_a[group] + np.where(n_b[group] == 1, step, 0)
        at_b = first_b[group] + np.where(n_b[group] == 1, 0, step)
        walked_a, walked_b = [], []
        for g in np.flatnonzero(~plain).tolist():
            i, j = int(first_a[g]), int(first_b[g])
            last_i, last_j = i + int(n_a[g]), j + int(n_b[g])
            until_i, until_j = int(self.length_a[ids_a[i]]), int(self.length_b[ids_b[j]])
            while True:
                walked_a.append(i)
                walked_b.append(j)
                on_a, on_b = until_i <= until_j, until_j <= until_i
                if on_a:
                    i += 1
                    if i == last_i:
                        break
                    until_i += int(self.length_a[ids_a[i]])
                if on_b:
                    j += 1
                    if j == last_j:
                        break
                    until_j += int(self.length_b[ids_b[j]])
        if not walked_a:
            return at_a, at_b
        at_a, at_b = np.concatenate((at_a, walked_a)), np.concatenate((at_b, walked_b))
        order = np.lexsort((at_b, at_a))
        return at_a[order], at_b[order]

    def groups_text(self, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`: the ids of each group, those of either list."""
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        ends_a, ends_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        ends_a[last_a - 1] = ends_b[last_b - 1] = 1
        merged = np.empty(len(ids_a) + len(ids_b), object)
        merged[np.arange(len(ids_a)) + np.repeat(last_b - n_b, n_a)] = self.text_a[ids_a + ends_a * len(self.length_a)]
        merged[np.arange(len(ids_b)) + np.repeat(last_a, n_b)] = self.text_b[ids_b + ends_b * len(self.length_b)]
        return "".join(merged.tolist())[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _code(ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """A pair of ids as one number."""
    return ids_a.astype(np.int64) << 32 | ids_b


BLOCK = (
    "block long, doc_ids array<{kind}>, sizes array<int>, width int, cuts binary, a binary, b binary, "
    "pairs array<long>, counts array<long>"
)


def _narrow(data: bytes, most: int) -> np.ndarray:
    """Four-byte numbers in the fewest bytes that hold `most`."""
    return np.frombuffer(data, "<u4").astype(_kind(most))


def _kind(most: int) -> str:
    return "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"


def _slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Rows in turn, as lists, cut where their texts pass TOGETHER characters."""
    own, held, size = [], [], 0
    for doc_id, text in zip(ids, texts):
        own.append(doc_id.as_py())
        held.append(text.as_py())
        size += len(held[-1])
        if size >= TOGETHER:
            yield own, held
            own, held, size = [], [], 0
    if own:
        yield own, held


def encode_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Documents encoded and aligned, in blocks of whole documents.

    `sizes` has three numbers per document: ids of a, ids of b, groups; `cuts` two per group, the
    ids of either side in it, of `width` bytes each; `a` and `b` are the ids, in as few bytes as
    their vocabularies allow. `pairs` are the distinct linked pairs of the block and `counts` how
    many of its links hold each.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T._parse_datatype_string(BLOCK.format(kind=own.schema["doc_id"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        kind, ids, held, n_links = None, [], [], 0

        def made() -> pa.RecordBatch:
            sizes = [n for a, b, cuts, _ in held for n in (len(a) // 4, len(b) // 4, len(cuts) // 8)]
            a, b, cuts, codes = map(b"".join, zip(*held))
            pairs, counts = np.unique(np.frombuffer(codes, np.int64), return_counts=True)
            most = int(np.frombuffer(cuts, "<u4").max(initial=0))
            columns = [
                pa.array([block], pa.int64()),
                pa.array([ids], pa.list_(kind)),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([np.dtype(_kind(most)).itemsize], pa.int32()),
                pa.array([_narrow(cuts, most).tobytes()], pa.binary()),
                pa.array([_narrow(a, len(both.length_a) - 1).tobytes()], pa.binary()),
                pa.array([_narrow(b, len(both.length_b) - 1).tobytes()], pa.binary()),
                pa.array([pairs], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_ids, texts in _slices(*batch.columns):
                whole = iter(both.together([t for t in texts if t]))
                for doc_id, text in zip(doc_ids, texts):
                    ids.append(doc_id)
                    held.append((next(whole) if text else None) or (b"", b"", b"", b""))
                    n_links += len(held[-1][3]) // 8
                    if n_links >= BLOCK_LINKS:
                        yield made()
                        ids, held, n_links, block = [], [], 0, block + 1
        if held:
            yield made()

    return own.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n, best: links of the corpus that hold each pair of ids, and whether that is the most of its b id.

    Blocks have counted their own links, so a pair in a third of all links is one row per block. The
    table has at most as many rows as the product of both vocabularies, in practice few per id.
    """
    met = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("met"))
    counts = met.groupBy(F.col("met.pairs").alias("pair")).agg(F.sum("met.counts").alias("n"))
    counts = materialize(counts.withColumn("b_id", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pair-counts")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align_tokenizers(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A byte-level vocabulary (a) encodes the text with a space before it, a sentencepiece model (b)
    the text, to which it adds that space itself. Groups are the shortest runs of ids that cover
    the same bytes; links are the pairs of tokens whose bytes overlap. A pair of ids counts as
    often as a link of the corpus holds it; n_best are the document's links whose count no other
    pair of their b id exceeds (ties are best, all of them), count_sum adds up the counts of its
    links. `groups` reads `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and those whose bytes a tokenizer changes, have no tokens: zeros and an
    empty `groups`. Ids, null ones too, are handed through; rows that repeat are rows of their own
    and count each. Long texts are encoded whole, in a block of their own. Other columns are not
    read. No rows give no rows.

    Every link's count comes back to it by the pair. While there are at most `most_pairs` pairs,
    their counts go to every task, at most 34 MB; beyond that each block's distinct pairs are
    joined to the counts and gathered, and the block with them.
    """
    import_path(docs.sparkSession)
    blocks = materialize(encode_blocks(docs, path_a, path_b, id_col, text_col), "aligned")
    counts = materialize(pair_counts(blocks), "pair-counts")
    schema = T._parse_datatype_string(RESULT.format(kind=docs.schema[id_col].dataType.simpleString()))
    packed = blocks.drop("pairs", "counts")
    sent = None
    if counts.count() <= most_pairs:
        table = counts.orderBy("pair").toArrow()
        arrays = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
        sent = docs.sparkSession.sparkContext.broadcast(arrays)
        whole = packed.withColumn("told", F.lit(None).cast("array<struct<pair:long,n:long,best:boolean>>"))
    else:
        told = blocks.select("block", F.explode("pairs").alias("pair")).join(counts, "pair")
        told = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("told"))
        whole = packed.join(told, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        both.forget()  # nothing is aligned here
        for batch in batches:
            for row in range(len(batch)):
                block = {name: batch.column(name)[row] for name in batch.schema.names}
                known = block["told"].values
                if sent is not None:
                    pairs, n, best = sent.value
                elif known is not None:
                    pairs, n = (known.field(x).to_numpy() for x in ("pair", "n"))
                    best = known.field("best").to_numpy(zero_copy_only=False)
                else:
                    pairs = n = best = np.empty(0, np.int64)
                sizes = np.array(block["sizes"].values, np.int64).reshape(-1, 3)
                kinds = (_kind(len(x) - 1) for x in (both.length_a, both.length_b))
                a, b = (np.frombuffer(block[x].as_buffer(), kind).astype(np.int64) for x, kind in zip("ab", kinds))
                cuts = np.frombuffer(block["cuts"].as_buffer(), f"<u{block['width'].as_py()}").astype(np.int64).reshape(-1, 2)
                # Documents stand one after the other, so their groups and links do.
                at_a, at_b = both.links(a, b, cuts[:, 0], cuts[:, 1])
                at = np.searchsorted(pairs, _code(a[at_a], b[at_b]))
                counted, good = (np.append(0, np.cumsum(x[at], dtype=np.int64)) for x in (n, best))
                # A group of p and q tokens has p + q - 1 links.
                until = np.append(0, np.cumsum(sizes[:, 0] + sizes[:, 1] - sizes[:, 2]))
                n_links, n_best, count_sum = np.diff(until), np.diff(good[until]), np.diff(counted[until])
                texts = []
                for (n_a, n_b, n_groups), (end_a, end_b, end) in zip(sizes.tolist(), np.cumsum(sizes, axis=0).tolist()):
                    cut = cuts[end - n_groups : end]
                    ids = a[end_a - n_a : end_a], b[end_b - n_b : end_b]
                    texts.append(both.groups_text(*ids, cut[:, 0], cut[:, 1]) if n_a else "")
                columns = [pa.array(x) for x in (*sizes.T.copy(), n_links, n_best, count_sum)]
                yield pa.RecordBatch.from_arrays([block["doc_ids"].values, *columns, pa.array(texts)], schema.names)

    return whole.drop("block").mapInArrow(run, schema)
