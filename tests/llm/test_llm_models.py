"""Scores and token ids again, by slow ways: word by word, letter by letter."""

import math
import random
import sys
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from rows import SF_DIR

from emberlog.llm import queries, tokens, toxicity
from emberlog.llm.common import free_name


def word_features(odds, word: bytes) -> list[float]:
    bare = word.strip(toxicity.EDGES) or word
    row, everything, mask = [float(odds.word[zlib.crc32(bare) % toxicity.BUCKETS])], [], (1 << 64) - 1
    data = b"^" + bare + b"$"
    for n in toxicity.GRAMS:
        own = []
        for at in range(len(data) - n + 1):
            h = 0
            for byte in data[at : at + n]:
                h = (h * 0x100000001B3 + byte + n) & mask
            own.append(float(odds.gram[(h ^ h >> 29) * 0x9E3779B97F4A7C15 % (1 << 64) >> 46]))
        row.append(max(own, default=0.0))
        everything += own
    row += [sum(everything) / max(len(everything), 1), min(everything, default=0.0), min(len(bare), 20) / 10]
    return [x / 3 for x in row]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def one_way(p, way, rows):
    """States of one direction, step by step."""
    h, state, out = toxicity.HIDDEN, [0.0] * toxicity.HIDDEN, []
    w, u, b = (p[k + way].astype(float) for k in "WUb")
    for row in rows:
        given, own = np.array(row) @ w + b, np.array(state) @ u
        r = [sigmoid(given[k] + own[k]) for k in range(h)]
        z = [sigmoid(given[h + k] + own[h + k]) for k in range(h)]
        new = [math.tanh(given[2 * h + k] + r[k] * own[2 * h + k]) for k in range(h)]
        state = [(1 - z[k]) * new[k] + z[k] * state[k] for k in range(h)]
        out.append(state)
    return out


def slow_score(model, text: bytes) -> float:
    words = text.lower().split()
    if not words:
        return model.base
    p, best = model.network.p, -math.inf
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(words):
        starts.append(starts[-1] + toxicity.STRIDE)
    for s in starts:
        rows = [word_features(model.odds, w) for w in words[s : s + toxicity.WINDOW]]
        back = one_way(p, "b", rows[::-1])[::-1]
        states = [f + b for f, b in zip(one_way(p, "f", rows), back)]
        weights = [math.exp(float(np.dot(p["v"], state))) for state in states]
        pooled = sum(np.array(state) * w for state, w in zip(states, weights)) / sum(weights)
        best = max(best, float(np.dot(p["w"], pooled) + p["c"][0]))
    return sigmoid(best)


@pytest.fixture(scope="module")
def model(spark):
    tables = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit_toxicity(*tables)


def test_toxicity_slowly(spark, model):
    rng = random.Random(3)
    words = "You are Pathetic, a the worthless! (of) and river Käfer été idiot ... 7 x".split()
    texts = [None, "", " \n", "x", "!!!"] + [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 5, 47, 48, 49, 80, 81, 113, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    for k, text in enumerate(texts):
        assert made[k] == pytest.approx(slow_score(model, (text or "").encode()), abs=1e-4)


def test_toxicity_sample_is_bounded(spark):
    """A document that stands there a thousand times is one, and the parameters bound the rest."""
    rows = [(i, f"text {i}") for i in range(50)] + [(1, "text 1")] * 1000 + [(1, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(50)] + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    texts, known = toxicity.training_rows(docs, labels, "doc_id", "text")
    taken = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(texts) == len(taken) and sum(known) == sum(i % 2 for i in taken) and texts.count(b"another") == 1
    assert sorted(toxicity.training_rows(docs, labels, "doc_id", "text", 4, 6)[1]) == [0] * 6 + [1] * 4


def test_toxicity_keeps_few_words(model):
    """A worker that meets ever new words forgets the old ones, and scores as one that begins anew."""
    texts = [" ".join(f"word{k}x{i}" for i in range(1000)).encode() for k in range(300)]
    scorer = toxicity.Scorer(model)
    made = scorer.score(iter(texts), len(texts))
    assert len(scorer.rows) <= 140_000 and len(scorer.table) <= 1 << 18
    for k in (0, 150, 299):
        assert made[k] == pytest.approx(toxicity.Scorer(model).score(iter(texts[k : k + 1]), 1)[0], abs=1e-5)


def test_toxicity_of_long_words_in_little_memory(model):
    """Texts without spaces: what is taken at once does not grow with the bytes of a batch."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij", k=5000)).encode() for _ in range(2400)]
    scorer = toxicity.Scorer(model)
    tracemalloc.start()
    made = [scorer.score(iter(texts[at : at + 1200]), 1200) for at in (0, 1200, 0)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000 and len(scorer.rows) == 1200
    assert made[0] == pytest.approx(made[2]) and made[1][7] == pytest.approx(slow_score(model, texts[1207]), abs=1e-4)


def test_toxicity_without_rows(spark, model):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    none = toxicity.fit_toxicity(docs.limit(0), labels)
    assert all(r.toxicity == pytest.approx(none.base) for r in toxicity.score_toxicity(docs.limit(9), none).collect())
    clash = docs.withColumnRenamed("lang", "toxicity")
    with pytest.raises(ValueError):
        toxicity.score_toxicity(clash, model)
    name = free_name(clash.columns, "toxicity")
    assert toxicity.score_toxicity(clash.limit(3), model, score_col=name).columns == [*clash.columns, "toxicity_"]


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    chunked = tokens.ChunkEncoder(queries.tokenizer_path())
    return lambda texts: [m.ids for m in plain.encode_batch(texts, add_special_tokens=False)], chunked


def test_every_letter_before_a_mark(encoders):
    plain, chunked = encoders
    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]
    letters = [c for c in letters if c < "㐀" or "豈" <= c < "𠀀"] + ["一", "가", "𠀀"]
    texts = [f"al{c}{mark} geldi" for c in letters for mark in ".,"]
    for text, ids in zip(texts, plain(texts), strict=True):
        assert chunked(text.encode()).tolist() == ids, text


def test_random_texts(encoders):
    plain, chunked = encoders
    rng = random.Random(9)
    parts = ["a", "İ", "হয়", "é", "é", "'s", "n't.", ",", ".", "...", " ", "\n", " ", "42", "<|endoftext|>", "<|", "ß", "🙂", "ALİ,", "The.", "X"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(6000)]
    for text, ids in zip(texts, plain(texts), strict=True):
        assert chunked(text.encode()).tolist() == ids, text


def test_texts_encoded_together_are_those_encoded_whole():
    """Many texts at once, cut into slices, have the ids of each text alone, marks after letters and special tokens included."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole, chunked = Tokenizer.from_file(path), tokens.ChunkEncoder(path)
    marks = [f"Word{m} é{m} don't{m} 7{m} {m}x a{m * 3} it{m}́ <|x{m}" for m in ".,!?;:$&%#*'|>"]
    texts = ["", " \t ", "End.<|endoftext|>", "ALİ, geldi.", *marks, "nächste  Zeile\x0bx " * 9] * 3
    rows = pa.array([t.encode() for t in texts], pa.binary())
    told = [chunked.together(part) for _, part in tokens._slices(pa.array(range(len(texts))), rows)]
    told += [chunked.together(rows.slice(s, 7)) for s in range(0, len(texts), 7)]
    made = [ids.tolist() for ids, n in told for ids in np.split(ids, np.cumsum(n)[:-1])]
    assert made == [m.ids for m in whole.encode_batch(texts, add_special_tokens=False)] * 2
