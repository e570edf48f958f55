"""Token ids in fixed-width bit-packed blocks."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import import_path

# Ids after which a block is closed, at the end of a document.
BLOCK_IDS = 1 << 18
# Bytes of text that are encoded together; a longer text alone.
TOGETHER = 1 << 22
# Encoded chunks in each of the two generations that a worker keeps; those not met go.
MOST_CHUNKS = 500_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of `width` bits each, lowest bit first, one after the other."""
    if width % 8 == 0:
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, width: int, first: int, n: int) -> np.ndarray:
    """Ids first to first + n of a packed block, without touching the bits before or after."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", n, first * width // 8).astype(np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * width
    raw = np.frombuffer(packed, np.uint8)[first * width // 8 : -(-(first + n) * width // 8)]
    data = np.concatenate((raw, np.zeros(8, np.uint8)))
    byte = (at >> 3) - first * width // 8
    word = np.zeros(n, np.uint64)
    for k in range(-(-(width + 7) // 8)):
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


class ChunkEncoder:
    """A tokenizer of the tokenizers library that keeps what it has encoded, chunk by chunk.

    For tokenizers that lower their input, cut it at ASCII white space and between a letter and the
    marks after it, drop the white space, and merge inside what is left: then a text's ids are
    those of its chunks in order, and a chunk that is met again need not be encoded again.
    `__init__` checks this on a probe.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = bool(suffix) and token.endswith(suffix)
        # Whether a word of lower-case ASCII letters reaches the merges as it is.
        letters, before = "abcdefghijklmnopqrstuvwxyz", self.tokenizer.pre_tokenizer
        as_it_is = self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str(letters) == letters
        self.bare = as_it_is and before is not None and [w for w, _ in before.pre_tokenize_str(letters)] == [letters]
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        probe = "It's  One,\n\tTwo-é́. <|endoftext|>x   3.4, ... THE END."
        if self._encoded([probe])[0] != self(probe.encode()).tobytes():
            raise ValueError(f"{path}: pieces cross white space; encode whole texts with it")

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk.

        Plain words go straight to the merges. Other words of letters are encoded in one text:
        every chunk ends a word at least once, so if there are as many ends as words, each end is
        a word's. What is left is encoded alone.
        """
        told: dict[str, bytes] = {}
        if self.bare:
            merged = self.tokenizer.model.tokenize
            for c in chunks:
                if c.isascii() and c.isalpha() and c.islower():
                    told[c] = array("I", [t.id for t in merged(c)]).tobytes()
        words = [c for c in chunks if c not in told and c.isalpha()]
        if words:
            (made,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
            ids = np.array(made.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                data, at = ids.tobytes(), (4 * ends).tolist()
                told.update((w, data[s:e]) for w, s, e in zip(words, [0, *at], at))
        rest = [c for c in chunks if c not in told]
        made = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        told.update((c, np.array(m.ids, np.uint32).tobytes()) for c, m in zip(rest, made))
        return [told[c] for c in chunks]

    def _learn(self, missing: list[bytes]) -> None:
        """Take chunks from the older generation or encode them.

        Marks after an ASCII letter are a piece of their own, so such a chunk is put together. Other
        letters may be taken apart before they are cut, and end in a mark.
        """
        recent, older = self.recent, self.older
        wanted, split = set(), []
        for c in missing:
            if (known := older.get(c)) is not None:
                recent[c] = known
                continue
            head = c.rstrip(MARKS)
            if len(head) < len(c) and head[-1:].isalpha() and b"<|" not in c:
                split.append((c, head, c[len(head) :]))
            else:
                wanted.add(c)
        wanted.update(part for _, *parts in split for part in parts)
        new = []
        for c in wanted:
            if c not in recent:
                if (known := older.get(c)) is None:
                    new.append(c)
                else:
                    recent[c] = known
        recent.update(zip(new, self._encoded([c.decode() for c in new])))
        recent.update((c, recent[head] + recent[tail]) for c, head, tail in split)

    def together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many of them each text has.

        Arrow cuts the texts and numbers their chunks, so each different chunk is looked up once.
        """
        if len(self.recent) > MOST_CHUNKS:
            self.older, self.recent = self.recent, {}
        # A text with <| may hold a special token, which is one by its case. Lowered here: Arrow's
        # if_else reads slices of text wrongly.
        own = [t if b"<|" in t else t.lower() for t in texts.to_pylist()]
        cut = pc.ascii_split_whitespace(pa.array(own, pa.large_binary()).cast(pa.large_string()))
        met = cut.flatten().dictionary_encode()
        chunks = met.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.recent.get, chunks))
        missing = [k for k, p in enumerate(parts) if p is None]
        self._learn([chunks[k] for k in missing])
        for k in missing:
            parts[k] = self.recent[chunks[k]]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.cumsum(size) - size
        at = met.indices.to_numpy()
        n = size[at]
        until = np.append(0, np.cumsum(n))
        places = np.repeat(first[at] - until[:-1], n) + np.arange(until[-1])
        ids = np.frombuffer(b"".join(parts), np.uint32)[places]
        return ids, np.diff(until[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))])

    def __call__(self, text: bytes) -> np.ndarray:
        return self.together(pa.array([text], pa.large_binary()))[0]


# No apostrophe, which may begin a piece, and nothing that special tokens are written with.
MARKS = b".,!?;:$&%#*"
_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker, so that what one has met serves the next."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows in turn, cut where their texts pass a multiple of TOGETHER bytes."""
    part = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TOGETHER
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist() if len(part) else []
    for s, e in zip(edges, edges[1:]):
        yield ids.slice(s, e - s), texts.slice(s, e - s)


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    end_id: int,
    sort: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every text, append `end_id`, and write packed blocks below `out`.

    The format is a Parquet table of blocks. A block holds whole documents: `packed` are their
    ids in the fewest bits for the vocabulary (`width`), `doc_ids` and `offsets` say which
    document starts at which id of the block, so that one document is one slice of bits. Blocks
    stand in order of (shard, block); a shard is what one task wrote, and a task that is run
    again writes the same. Documents stand by ascending id (null last, then by text) with `sort`,
    which range-partitions them; without it in the order in which they are read.

    Null text counts as empty: the end id alone. Repeated rows are written as often as they come.
    Other columns are not read. Without documents there are no blocks. A text is encoded whole,
    and a long one makes a long block of its own.
    """
    import_path(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if sort:
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
        own = own.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    kind = own.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("offsets", T.ArrayType(T.LongType())),
            T.StructField("packed", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer)
        width = bits_for(max(encode.vocabulary, end_id + 1))
        shard, block = TaskContext.get().partitionId(), 0
        ids, parts, offsets, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([width], pa.int32()),
                pa.array([held], pa.int64()),
                pa.array([ids], pa.list_(kind_of)),
                pa.array([offsets], pa.list_(pa.int64())),
                pa.array([pack(np.concatenate(parts), width)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for doc_ids, texts in _slices(*batch.columns):
                told, sizes = encode.together(texts)
                for doc_id, own in zip(doc_ids.to_pylist(), np.split(told, np.cumsum(sizes)[:-1])):
                    ids.append(doc_id)
                    offsets.append(held)
                    parts += (own, end)
                    held += len(own) + 1
                    if held >= block_ids:
                        yield made()
                        ids, parts, offsets, held, block = [], [], [], 0, block + 1
        if ids:
            yield made()

    own.mapInArrow(run, schema).write.option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, path: str, take: Callable[[np.ndarray], object], returns: str) -> DataFrame:
    """Read blocks back: doc_id, shard, at (ids before it in its shard's block), block, n_tokens, value.

    `take` gets a document's ids as they were written, its end id included, and gives `value`, of
    the Arrow type that `returns` names ("uint32" becomes a long).
    """
    import_path(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("shard", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("at", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("value", T.LongType() if returns == "uint32" else T._parse_datatype_string(returns)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                b = {name: batch.column(name)[row] for name in batch.schema.names}
                offsets = np.array(b["offsets"].values.to_numpy(zero_copy_only=False), np.int64)
                sizes = np.diff(np.append(offsets, b["n_ids"].as_py()))
                packed, width = b["packed"].as_buffer(), b["width"].as_py()
                values = [take(unpack(packed, width, s, n)) for s, n in zip(offsets.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_ids"].values,
                        pa.array(np.full(len(sizes), b["shard"].as_py(), np.int32)),
                        pa.array(np.full(len(sizes), b["block"].as_py(), np.int32)),
                        pa.array(offsets),
                        pa.array(sizes),
                        pa.array(values, pa.int64() if returns == "uint32" else None),
                    ],
                    schema.names,
                )

    return blocks.select("shard", "block", "width", "n_ids", "doc_ids", "offsets", "packed").mapInArrow(run, schema)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, first: how many ids all blocks before it hold.

    Shards are summed first; the running sum over them has one row per writing task. Blocks are
    then numbered inside their shard.
    """
    from pyspark.sql import Window

    sizes = spark.read.parquet(path).select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inner = sizes.select("shard", "block", F.coalesce(inside, F.lit(0)).alias("inside"))
    return inner.join(shards, "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("first"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    read = read_tokens(spark, path, crc32, "uint32")
    located = read.join(block_starts(spark, path), ["shard", "block"])
    return located.select(
        "doc_id",
        (F.col("first") + F.col("at")).alias("start"),
        "n_tokens",
        F.col("value").alias("ids_crc32"),
    )


def document_ids(spark: SparkSession, path: str, wanted: Column) -> DataFrame:
    """Random access: doc_id and ids of the documents that `wanted` picks, from their blocks alone."""
    blocks = spark.read.parquet(path).where(F.exists("doc_ids", lambda i: wanted(i) if callable(wanted) else i == wanted))
    import_path(spark)
    kind = blocks.schema["doc_ids"].dataType.elementType
    at = blocks.select("width", "n_ids", "offsets", "packed", F.posexplode("doc_ids").alias("k", "doc_id"))
    at = at.where(wanted(F.col("doc_id")) if callable(wanted) else F.col("doc_id") == wanted)
    first = F.get("offsets", F.col("k"))
    slices = at.select("doc_id", "width", first.alias("first"), (F.coalesce(F.get("offsets", F.col("k") + 1), "n_ids") - first).alias("n"), "packed")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("packed", "width", "first", "n")))
            ids = [unpack(p.as_buffer(), w.as_py(), f.as_py(), n.as_py()).astype(np.int64) for p, w, f, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], schema.names)

    return slices.mapInArrow(run, schema)
