"""Language, ranked search and alignment against brute force on tables that hold the awkward cases."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import SF_DIR

from emberlog.llm import alignment, language, queries, ranked

WORDS = "The of the and, in AN re. ti ou's er-on hand stone river Käfer été año İĞ 7 42 x ß 東京 naïve".split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, term string, terms string, score string, rank string, "
    "block string, pairs string, held_out string, task string, item_id string, n string, part string, place string"
)
EXTRA = ["clash"] * 13


def awkward(seed=5, n=60):
    """Copies, nulls, blanks, ties, a long text, strange characters, repeated rows and null ids."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "a", "é", "...", "▁ mark", "<s> </s> <|endoftext|>", "\x00 nul", " wide　", "👍🏽 ok"]
    for _ in range(n):
        texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) + rng.choice(["", ".", "\n", "  "]))
    texts += [texts[20], texts[21], texts[21] + " extra", " ".join(rng.choice(WORDS) for _ in range(20_000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[25], rows[25], (None, texts[20]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, *EXTRA) for i, t in rows], SCHEMA)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = [
    (0, "hand stone river"), (1, "The THE the of"), (2, None), (3, "..."), (4, "nothing of zzz"), (5, "Käfer été"), (5, "7 42"),
    (6, "zzz"), (None, "x ß"), (7, " ".join(WORDS) + " " + " ".join(f"t{i}" for i in range(70))),
]


def items_frame(spark):
    return spark.createDataFrame(ITEMS, "item_id int, text string")


@pytest.mark.parametrize("query_bytes", [ranked.QUERY_BYTES, 60])
def test_ranked(spark, rows, query_bytes):
    made = ranked.rank_documents(frame(spark, rows).repartition(3), items_frame(spark), query_bytes=query_bytes)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert plain(made) == sorted(brute.ranked(rows, ITEMS), key=repr)


def test_ranked_in_small_blocks(spark, rows):
    """Many blocks per task: what is known of an item must not hide a better document."""
    index = ranked.index_documents(frame(spark, rows), {t: k for k, t in enumerate({t for _, x in ITEMS for t in brute.terms(x)})}, "doc_id", "text")
    held = [r for r in index.collect() if r.doc_id is not None]
    weights = np.random.default_rng(1).integers(0, 5, 200)
    total, words = len(held), sum(r.n for r in held)
    asked = np.unique(np.concatenate([r.terms for r in held])).astype(np.int64)

    def block(part):
        doc = np.repeat(np.arange(len(part)), [len(r.terms) for r in part])
        term, tf = (np.array([x for r in part for x in r[c]], np.int64) for c in ("terms", "counts"))
        ids, sizes = (np.array([r[c] for r in part], np.int64) for c in ("doc_id", "n"))
        return ranked.Block(ids, sizes, doc, term, tf, weights, total, words)

    whole = block(held).best(asked, 5, np.empty(0, np.int64), np.empty(0, np.int64))
    known = (np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(held), 4):
        known = block(held[at : at + 4]).best(asked, 5, *known)
    assert [x.tolist() for x in known] == [x.tolist() for x in whole] and len(known[0]) == 5


def test_ranked_without_rows(spark, rows):
    docs, items = frame(spark, rows), items_frame(spark)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id < 3"), items)):
        made = ranked.rank_documents(d, i)
        assert made.count() == 0 and made.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path(queries.BYTE_LEVEL), queries.tokenizer_path(queries.PIECES)


@pytest.fixture(scope="module")
def encoders(paths):
    """The libraries themselves, with the bytes of tokens read off in another way."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=paths[1])

    def encode_a(text):
        made, data = a.encode(text, add_special_tokens=False), text.encode()
        # Characters of a token in the vocabulary are its bytes, one each.
        sizes = [len(a.id_to_token(i)) for i in made.ids]
        ends = np.cumsum(sizes).tolist()
        return [(i, data[e - n : e]) for i, n, e in zip(made.ids, sizes, ends)]

    def encode_b(text):
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return [(i, bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]

    return encode_a, encode_b


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_alignment(spark, rows, paths, encoders, most_pairs):
    """Counts sent to every task, and joined."""
    short = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    made = alignment.align_tokenizers(frame(spark, short).repartition(3), *paths, most_pairs=most_pairs)
    expected = brute.aligned(short, *encoders)
    assert plain(made) == sorted(expected, key=repr)
    assert sum(r[1] > 0 for r in expected) > 40 and [r[1:] for r in expected if r[0] == 6] == [(0, 0, 0, 0, 0, 0, "")]


def test_chunks_are_aligned_as_the_whole(paths):
    """Texts with every kind of white space, cut at spaces and not; a small cache, so that chunks come and go."""
    rng = random.Random(7)
    parts = WORDS + [" ", "  ", "\n", "\t ", "\xa0", "\u2003", "\x1c", "'s", "n't", "42", "...", "▁", "▁▁", "\u0301", "İ", "👍🏽", "\x00", "<s>", "ﬁ"]
    texts = [""]
    for _ in range(1500):
        texts.append("".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(1, 12))))
    cut, whole = alignment.Aligner(*paths), alignment.Aligner(*paths)
    assert cut.in_chunks
    whole.in_chunks = False
    for text in texts:
        assert " ".join(alignment.chunks_of(text)) == text
        assert cut(text) == whole(text), repr(text)


def test_alignment_of_a_long_text(spark, paths):
    """Slices tile both lists, and every link's bytes overlap, in 4 MB of text that is one block."""
    rng = random.Random(2)
    text = " ".join(rng.choice(WORDS) + rng.choice(["", "ung", "3"]) for _ in range(700_000))
    both = alignment.Aligner(*paths)
    a, b, cuts, codes = (np.frombuffer(x, k) for x, k in zip(both(text), ("<u4", "<u4", "<u4", "<i8")))
    n_a, n_b = cuts.reshape(-1, 2).T.astype(int)
    assert n_a.sum() == len(a) and n_b.sum() == len(b) and min(n_a.min(), n_b.min()) == 1
    at_a, at_b = both.links(a, b, n_a, n_b)
    assert len(at_a) == len(a) + len(b) - len(n_a) == len(codes)
    ends_a, ends_b = np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b])
    starts_a, starts_b = ends_a - both.length_a[a], ends_b - both.length_b[b]
    assert (starts_a[at_a] < ends_b[at_b]).all() and (starts_b[at_b] < ends_a[at_a]).all()
    made = alignment.align_tokenizers(frame(spark, [(1, text)]), *paths).head()
    assert (made.n_a, made.n_b, made.n_groups, made.n_links) == (len(a), len(b), len(n_a), len(at_a))


def test_alignment_without_rows(spark, rows, paths):
    made = alignment.align_tokenizers(frame(spark, rows).limit(0), *paths)
    assert made.count() == 0 and made.columns[0] == "doc_id" and made.columns[-1] == "groups"
    empty = alignment.align_tokenizers(frame(spark, [(1, None), (1, ""), (None, None)]), *paths)
    assert plain(empty) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 1, None)], key=repr)


def test_alignment_query(spark, encoders):
    """The registered query over the whole table; brute force with the same counts in fewer steps."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1]) < 4000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    paths = queries.tokenizer_path(queries.BYTE_LEVEL), queries.tokenizer_path(queries.PIECES)
    made = {r.doc_id: tuple(r) for r in alignment.align_tokenizers(docs, *paths).collect()}
    assert made == {r[0]: r for r in brute.aligned(rows, *encoders)}
    whole = queries.op13_alignment(spark, SF_DIR)
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert whole.count() == table.count()
    same = [r for r in whole.collect() if r.doc_id in made]
    assert all(made[r.doc_id][1:5] == tuple(r)[1:5] for r in same)
    assert all(r.groups_sha256 == hashlib.sha256(made[r.doc_id][7].encode()).hexdigest() for r in same)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_query(spark):
    """Held-out accuracy, and every row's answer again by a slow scorer."""
    sf = SF_DIR.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    made = queries.op11_language(spark, sf).collect()
    assert sorted(r.doc_id for r in made) == sorted(texts)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in made)
    checked = [r for r in made if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == texts[r.doc_id][1] for r in checked) >= 0.97 * len(checked) > 100


@pytest.fixture(scope="module")
def model(spark):
    return language.fit_language(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_language_slowly(spark, model, rows):
    """n-gram by n-gram, machine by machine."""
    texts = [(i, t) for i, t in rows if t is None or len(t) < 600]
    made = language.predict_language(frame(spark, texts), model)
    expected = []
    for i, text in texts:
        if not any(c.isalpha() for c in text or ""):
            expected.append((i, "und", 0.0))
            continue
        x = np.sqrt(np.array(brute.gram_counts(text, language.BUCKETS, language.GRAMS), float))
        x = np.append(x / np.sqrt((x * x).sum()), 1)

        def winner(group, members):
            votes = dict.fromkeys(members, 0.0)
            for k, (own, a, b) in enumerate(model.pairs):
                if own == group:
                    p = 1 / (1 + np.exp(-2 * float(model.weights[k].astype(float) @ x)))
                    votes[a] += p
                    votes[b] += 1 - p
            best = max(sorted(votes), key=votes.get)
            return best, votes[best] / (len(members) - 1) if len(members) > 1 else 1.0

        family, sure = winner("", sorted(model.families))
        lang, surer = winner(family, model.families[family])
        expected.append((i, lang, sure * surer))
    found, wanted = plain(made), sorted(expected, key=repr)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4


def test_language_learns_no_held_out_row(spark):
    """Held-out rows, null languages and texts without letters leave no trace."""
    rng = random.Random(4)
    lists = {"en": "the of and that", "de": "der und das nicht", "xx": "zzq qqz zqz"}
    rows = [(i, " ".join(rng.choice(words.split()) for _ in range(30)), lang) for i in range(300) for lang, words in lists.items()]
    learned = [r for r in rows if not held_out(r[0])]
    noise = [(r[0], r[1], "wrong") for r in rows if held_out(r[0])] + [(1, "the of", None), (1, "123", "no"), (1, None, "no")]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(learned + noise, schema)
    model = language.fit_language(docs, rows=20)
    assert model.families == {"germanic": ["de", "en"], "xx": ["xx"]} and len(model.pairs) == 2
    asked = spark.createDataFrame([(k, t, None) for k, t in enumerate(lists.values())], schema)
    assert [r.lang_pred for r in language.predict_language(asked, model).orderBy("doc_id").collect()] == ["en", "de", "xx"]
    repeated = spark.createDataFrame(learned + [learned[0]] * 500, schema)
    assert language.fit_language(repeated, rows=20).pairs == model.pairs
    sample = language.training_rows(repeated, {"en": 800, "de": 300, "xx": 300}, dict.fromkeys(lists, 20), "doc_id", "text", "lang")
    assert sorted(sample.groupBy("lang").count().collect()) == [("de", 20), ("en", 20), ("xx", 20)]


def test_language_with_little_to_learn(spark, rows):
    docs = frame(spark, rows)
    none = language.fit_language(docs.limit(0))
    assert set(language.predict_language(docs, none).agg(F.collect_set("lang_pred")).head()[0]) == {"und"}
    one = language.fit_language(docs)
    told = {r.lang_pred: r.score for r in language.predict_language(docs, one).collect()}
    assert told == {"en": 1.0, "und": 0.0}
    assert language.predict_language(docs.limit(0), one).count() == 0


def test_language_of_a_long_text(monkeypatch):
    """Taken in parts, a text has the counts that it has in one piece."""
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) for _ in range(1_000_000))
    parts = language.gram_counts(text)
    monkeypatch.setattr(language, "BYTES_AT_ONCE", 1 << 30)
    assert len(text.encode()) > 4 << 20 and (parts == language.gram_counts(text)).all()


def test_texts_aligned_together_are_those_aligned_whole():
    """New chunks of many texts are aligned once; those without an alignment hold up none of the others."""
    paths = [queries.tokenizer_path(name) for name in (queries.BYTE_LEVEL, queries.PIECES)]
    words = [f"w{i}or{'xyz'[i % 3]}d" for i in range(300)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 300, 20)] + ["a  b ", "ﬁn … ½", " ".join([*words[:50], "ﬁn"]), "one two"]
    many, whole = alignment.Aligner(*paths), alignment.Aligner(*paths)
    assert many.in_chunks and many.together(texts) == [made or None for made in whole.align(texts)]
    assert many.together([]) == []
