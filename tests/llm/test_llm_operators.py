"""Each operator against brute force on tables that hold the awkward cases."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm import chat, decontaminate, exact, mixing, queries, simhash, substrings, suffixes, templates, tokens, toxicity

WORDS = "of the and in an re ti ou er on hand stone river light käfer été año 7 42 x".split()
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    # Names that the operators use inside themselves.
    + [T.StructField(c, T.StringType()) for c in ("uid", "fp", "key", "chunk", "words", "masked", "source", "doc", "spans")]
)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(seed=3, n=40):
    """Copies, near copies, shared passages, nulls, blanks, ties, a long text, and repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts = [None, "", " \t\n", "a", "a  b\x0bc", "A a", passage, passage + " tail", "head " + passage]
    texts += ["ab" * 300, "z" * 700, "Log 12 of host a7\nLog 13 of host b9\n\nkeep this one line", prose(rng, 9000)]
    for _ in range(n):
        texts.append(prose(rng, rng.randint(1, 160)) + rng.choice(["", "\n" + passage, "\nLog 5 of host c3", ". " + prose(rng, 60)]))
    texts += [texts[14], texts[14].replace(" ", "  "), texts[15] + " extra", texts[13], texts[13]]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    out = awkward()
    return out + [out[20], out[20], (None, "only null has this " * 3), (None, out[20][1]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 6, "s" if i is None else f"s{i % 3}", "clash", "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def none_left(df):
    assert df.count() == 0


def test_exact(docs, rows):
    made = exact.exact_dedup(docs)
    assert got(made, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(rows), key=repr)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns


def test_exact_with_colliding_identifiers(docs, rows):
    """Identifiers of one byte: every recipe is doubtful, and the whole texts decide."""
    made = exact.exact_dedup(docs, identify=lambda c: F.unhex(F.substring(F.md5(c), 1, 2)))
    assert got(made, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(rows), key=repr)


def test_simhash(docs, rows):
    made = simhash.near_copies(docs).withColumn("fingerprint", simhash.fingerprint_hex(F.col("fp")))
    assert got(made, "doc_id", "fingerprint", "component_id") == sorted(brute.simhash(rows), key=repr)


@pytest.mark.parametrize("n, bits, groups", [(400, 10, 1), (3000, 12, 1), (2000, 12, 40), (700, 9, 3)])
def test_bucket_links(n, bits, groups):
    rng = np.random.default_rng(n)
    prints = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64) << np.uint64(9))
    keys = np.sort(rng.integers(0, groups, len(prints)))

    def classes(links):
        of = list(range(len(prints)))

        def root(x):
            while of[x] != x:
                of[x] = of[of[x]]
                x = of[x]
            return x

        for a, b in links:
            of[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(len(prints))]

    near = [
        (i, j)
        for i in range(len(prints))
        for j in np.flatnonzero((np.bitwise_count(prints[:i] ^ prints[i]) <= 2) & (keys[:i] == keys[i]))
    ]
    assert classes(zip(*map(np.ndarray.tolist, simhash.bucket_links(keys, prints, 2)))) == classes(near)


def test_lines(docs, rows):
    made = templates.find_recurring_lines(docs, min_docs=2)
    expected = [(i, n, dropped) for i, n, dropped in brute.recurring_lines(rows, min_docs=2)]
    assert got(made, "doc_id", "n_lines", "dropped") == sorted(expected, key=repr)
    cleaned = templates.drop_recurring_lines(docs, min_docs=2)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    log = cleaned.where("doc_id = 11").head()["text"]
    assert "keep this one line" in log and "Log" not in log


def test_mixing(docs, rows):
    made = mixing.mix_sources(docs, {"s0": 1.0, "s1": 3.0}, epochs=40.0).select("doc_id", "source", "mix_copy", "mix_key", "mix_copies").collect()
    assert {r["source"] for r in made} <= {"s0", "s1"}
    assert [r["mix_key"] for r in made] == sorted(r["mix_key"] for r in made)
    sizes = {s: sum(len(t or "") + 1 for i, t in rows if i is not None and f"s{i % 3}" == s) for s in ("s0", "s1", "s2")}
    total = sum(len(t or "") + 1 for _, t in rows)
    for source, share in (("s0", 0.25), ("s1", 0.75)):
        rate = 40.0 * total * share / sizes[source]
        ids = {i for i, _ in rows if i is not None and f"s{i % 3}" == source}
        mean = len({(r["doc_id"], r["mix_copy"]) for r in made if r["source"] == source}) / len(ids)
        assert abs(mean - rate) < 5 * (rate / len(ids)) ** 0.5
    again = mixing.mix_sources(docs.repartition(7), {"s0": 1.0, "s1": 3.0}, epochs=40.0).select("mix_key").collect()
    assert [r["mix_key"] for r in again] == [r["mix_key"] for r in made]


def test_poisson_inverse(spark):
    rates = [0.0, 0.3, 2.0, 40.0, 900.0]
    steps = spark.createDataFrame([(r,) for r in rates], "rate double").select("rate", mixing.poisson_steps(F.col("rate")).alias("s"))
    for r in steps.collect():
        cdf = np.array(r["s"])
        assert abs(cdf[-1] - 1) < 1e-9
        mean = (1 - cdf).sum()
        assert abs(mean - r["rate"]) < 1e-6 * max(1, r["rate"])


def test_contamination(spark, docs, rows):
    items = [(1, rows[6][1]), (2, "hand stone river"), (3, None), (4, " .,! "), (None, "x 42"), (10, "hand stone river")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0, "spans"
    )
    collected = found.collect()
    assert sorted([tuple(r)[:6] for r in collected], key=repr) == sorted(brute.contamination(rows, items), key=repr)
    for r in collected:
        assert sum(s["n"] for s in r["spans"]) == r["n_hit"]
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[2] for r in collected)
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.count() == len(rows)
    assert decontaminate.find_contamination(cut.where("doc_id = 6"), bench.where("item_id = 1")).head()["n_hit"] == 0
    none_left(decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0"))


def test_word_windows(docs, rows):
    made = substrings.drop_repeated_words(docs, window=50)
    expected = sorted(brute.word_windows(rows), key=repr)
    assert got(made, "doc_id", "n_words", "n_removed", F.sha2("kept", 256)) == expected
    assert any(r[2] for r in expected)


@pytest.mark.parametrize("hot", [100_000, 5])
def test_byte_windows(spark, rows, monkeypatch, hot):
    """Also with hot minimisers and small parts, so that windows travel one by one and parts carry on."""
    from emberlog.llm import windows

    monkeypatch.setattr(windows, "HOT_WINDOWS", hot)
    unique = list({i: (i, t) for i, t in rows if i is not None}.values())
    unique = [(i, t[:4000] if t else t) for i, t in unique]
    made = suffixes.drop_repeated_bytes(frame(spark, unique).repartition(3))
    expected = sorted(brute.byte_windows(unique), key=repr)
    assert got(made, "doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)) == expected


def test_repeated_rows_are_one_document(spark):
    text = "0123456789" * 9 + "abcdefghijklmnop" + "q" * 30
    made = suffixes.drop_repeated_bytes(spark.createDataFrame([(5, text), (5, text), (6, text)], "doc_id long, text string"))
    assert sorted(r["n_removed"] for r in made.where("doc_id = 5").collect()) == [0, 0]
    assert made.where("doc_id = 6").head()["n_removed"] == len(text)


def test_settled_strings_are_not_refined():
    """Copies of an earlier document's string, and strings alone in their bucket, need no refinement."""
    from emberlog.llm import windows

    rng = np.random.default_rng(3)
    units = windows.Units(100, 20, words=False, same_document=True)
    a, lone, left, right = (bytes(rng.integers(97, 123, k, dtype=np.uint8)) for k in (130, 150, 40, 40))
    own = (a[:37] * 5)[:150]  # repeats its own windows
    strings = [(1, 10, a), (1, 20, a), (1, 30, a), (2, 10, lone), (3, 10, own), (4, 10, left + a), (4, 20, a + right)]

    def key(number, text):
        grams = windows.range_hashes(np.frombuffer(text, np.uint8), np.array([20]), np.array([40]))
        return int(grams.view(np.int64)[0]) if number == 3 else number

    rows = [(key(k, t), doc, 10 * doc + k, 0, len(t) - 99, False, t) for k, doc, t in strings]
    given = []

    def group(data, first, end):
        given.append(len(first))
        return suffixes.refined_buckets(data, first, 100)

    table = pa.Table.from_batches([windows._strings(*zip(*rows))])
    spans, singles, holds = windows.repeated_spans(units, group, table)
    gone = {(r["uid"], p) for r in spans.to_pylist() for p in range(r["first"], r["first"] + r["n"])}
    met, expected = set(), set()
    for k, doc, uid, _, n, _, text in sorted(rows, key=lambda r: r[1]):
        for p in range(n):
            window = text[p : p + 100]
            if (k, window) in met:
                expected.add((uid, p))
            met.add((k, window))
    assert gone == expected and len(expected) > 80
    assert singles.num_rows == 0
    assert sum(given) == sum(len(t) - 99 for t in (own, left + a, a + right))


def test_spans_in_a_row_are_one(spark):
    """A passage met again in a task travels as one span, however many minimisers it has."""
    from emberlog.llm import windows

    text = bytes(np.random.default_rng(4).integers(97, 123, 900, dtype=np.uint8))
    units = windows.Units(100, 20, words=False, same_document=True)
    key, first, n, _ = windows.super_kmers(units, text)
    assert len(key) > 5
    cuts = [(f, k, h, False) for h, f, k in zip(key.view(np.int64).tolist(), first.tolist(), n.tolist())]
    schema = "uid long, doc long, text binary, cuts array<struct<first:int,n:int,key:long,hot:boolean>>"
    joined = spark.createDataFrame([(7, 1, text, cuts), (8, 2, text, cuts)], schema).coalesce(1)
    made = windows.cut_out(joined, units).collect()
    assert [(r["uid"], r["first"], r["n"]) for r in made if r["packed"] is None] == [(8, 0, 801)]
    assert sorted((r["first"], r["n"]) for r in made if r["packed"] is not None) == [c[:2] for c in cuts]


def test_refined_buckets():
    rng = np.random.default_rng(5)
    data = np.frombuffer(bytes(rng.integers(97, 99, 4000, dtype=np.uint8)) * 2 + b"a" * 300, np.uint8)
    for length in (1, 3, 10, 100):
        first = np.arange(len(data) - length + 1)
        ids = suffixes.refined_buckets(data, first, length)
        raw = data.tobytes()
        by_text = {}
        for i, k in zip(ids.tolist(), first.tolist()):
            assert by_text.setdefault(raw[k : k + length], i) == i
        assert len(set(ids.tolist())) == len(by_text)


def test_pack_and_unpack():
    rng = np.random.default_rng(0)
    for width in (1, 5, 8, 13, 16, 17, 24, 31):
        ids = rng.integers(0, 1 << width, 999).astype(np.uint32)
        packed = tokens.pack(ids, width)
        assert len(packed) == -(-999 * width // 8)
        assert (tokens.unpack(packed, width, 0, 999) == ids).all()
        assert (tokens.unpack(packed, width, 321, 55) == ids[321:376]).all()
        assert len(tokens.unpack(packed, width, 7, 0)) == 0


def test_token_files(spark, tmp_path, docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    hard = [(900, "It's  ONE, İstanbul é́. <|endoftext|>x 3.4, ... Σίσυφος. THE END."), (901, "<|ENDOFTEXT|> don't. ,, a.,b \x1d. \x85")]
    every = rows + hard
    own = docs.unionByName(frame(docs.sparkSession, hard))
    tokens.write_tokens(own, str(tmp_path / "t"), path, 1, block_ids=500)
    plain = Tokenizer.from_file(path)
    ordered = sorted(every, key=lambda r: (r[0] is None, r[0] or 0))
    expected, start = [], 0
    for i, text in ordered:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), start))
        start += len(ids)
    made = tokens.token_digest(spark, str(tmp_path / "t"))
    assert got(made, "doc_id", "n_tokens", "ids_crc32") == sorted([e[:3] for e in expected], key=repr)
    starts = {(r["doc_id"], r["start"]) for r in made.collect()}
    assert {(e[0], e[3]) for e in expected if e[0] not in (None, rows[20][0])} <= starts
    one = tokens.document_ids(spark, str(tmp_path / "t"), F.lit(900)).head()
    assert list(one["ids"]) == plain.encode(hard[0][1], add_special_tokens=False).ids + [1]


def test_chats(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", r"[\INST] \ [\\/INST] </s", "[SYS]", "[/ROLE]a</s>b", "", None, "é[", "[/INST", "x" * 9000]
    rng = random.Random(1)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE]", None]), rng.choice(texts))
        for c in (1, 2, 3, None, 5, 6, 7)
        for t in (0, 1, 2, 2, 3, None, 4)
    ]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    seen = got(made, "conv_id", "n_turns", F.sha2(told, 256), F.char_length(loss), F.sha2(loss, 256))
    assert seen == sorted(brute.chats(rows), key=repr)
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    assert made.where(joined != F.col("formatted")).count() == 0


def test_gradients():
    rng = np.random.default_rng(2)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(6, 5, toxicity.FEATURES))
    mask = np.ones((6, 5, 1))
    mask[4:, 2] = 0
    y = np.array([0, 1, 1, 0, 1.0])

    def loss():
        z = net.forward(x, mask).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z)

    g = net.gradients(x, mask, y)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        kept, step = value[at], 1e-2
        value[at] = kept + step
        up = loss()
        value[at] = kept - step
        down = loss()
        value[at] = kept
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3, name


def test_lexicon_of_short_words():
    odds = toxicity.Odds(np.ones(toxicity.BUCKETS, np.float32), np.ones(toxicity.BUCKETS, np.float32))
    for words in ([b"a"], [b"?"], [b"a", b"bc", b"a longer one"], [b"\xc3\xa9"]):
        assert odds.features(toxicity.Lexicon(words)).shape == (len(words), toxicity.FEATURES)


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    bad = ["grubwort", "schnodder", "mufflon"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ing", "est"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(None, None), (5000, ""), (5001, " \n"), (5002, "a"), (5003, "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels + [(7, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    scored = toxicity.score_toxicity(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(scored) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in scored)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored if r["doc_id"] is not None)
    held = [r for r in scored if r["held"] and r["doc_id"] < 900]
    right = sum((r["toxicity"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held)
    assert len(held) > 150 and right / len(held) > 0.95
    empty = toxicity.fit_toxicity(docs, known.limit(0))
    assert toxicity.score_toxicity(docs.limit(3), empty).count() == 3


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    none_left(exact.exact_dedup(docs))
    none_left(simhash.near_copies(docs))
    none_left(templates.find_recurring_lines(docs))
    none_left(mixing.mix_sources(docs))
    none_left(decontaminate.find_contamination(docs, bench))
    none_left(substrings.drop_repeated_words(docs))
    none_left(suffixes.drop_repeated_bytes(docs))
    none_left(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))


def test_empty_token_files(spark, tmp_path):
    tokens.write_tokens(frame(spark, []), str(tmp_path / "none"), queries.tokenizer_path(), 1)
    none_left(tokens.token_digest(spark, str(tmp_path / "none")))
