"""Columns called like what operators use inside, repeated rows and empty tables, for all that change documents."""

import pytest

import corpus_pipeline
from emberlog.llm import decontaminate, exact, mixing, simhash, templates
from rows import SF_DIR

INSIDE = (
    "_kept_id _same kept_doc_id _hit_uid _hit_spans _line_uid _line_dropped mix_source mix_steps mix_copies mix_copy mix_key "
    "mix_size mix_rate toxicity uid doc fp key words spans items copies copy masked leaf hits score one share size block"
).split()
TEXTS = [
    (1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (2, "a  b c d e f g h i j k"), (3, None), (4, ""), (None, "a b"),
    (None, "a b"), (5, "Log 1 of it all\nkeep\nLog 2 of it all"), (6, "Log 3 of it all"), (7, "Log 4 of it all"), (8, "x y z " * 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", *["mine"] * len(INSIDE)) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{c} string' for c in INSIDE)}")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "c d e f g h i j k l"), (2, "b c d e f g h i j k")], "item_id int, text string")


def operators(items):
    return {
        "copies": exact.drop_copies,
        "near": lambda d: simhash.drop_near_copies(d, shingle=3, radius=2),
        "lines": templates.drop_recurring_lines,
        "documents": lambda d: decontaminate.decontaminate(d, items),
        "spans": lambda d: decontaminate.decontaminate(d, items, remove="spans"),
        "mixing": mixing.mix_sources,
    }


@pytest.mark.parametrize("name", ["copies", "near", "lines", "documents", "spans", "mixing"])
def test_clashing_names_and_no_rows(docs, items, name):
    operator = operators(items)[name]
    made = operator(docs)
    assert made.columns[: len(docs.columns)] == docs.columns
    rows = made.collect()
    assert rows and all(r[c] == "mine" for r in rows for c in INSIDE)
    plain = operator(docs.select("doc_id", "text", "source")).select("doc_id", "text").collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, made.select("doc_id", "text").collect()))
    assert operator(docs.limit(0)).count() == 0


def test_one_of_equal_rows_stays(docs):
    kept = sorted(((r.doc_id, r.text) for r in exact.drop_copies(docs).collect()), key=repr)
    assert [i for i, _ in kept].count(1) == 1 and (2, "a  b c d e f g h i j k") not in kept
    assert [t for i, t in kept if i is None] == ["a b"] and [i for i, _ in kept].count(3) + [i for i, _ in kept].count(4) == 1


def test_added_columns_get_other_names(docs):
    assert mixing.mix_sources(docs).columns[-3:] == ["mix_copies_", "mix_copy_", "mix_key_"]


def test_spans_of_documents_are_cut(docs, items):
    told = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}
    assert told[2] == "a" and told[8] == "x y z " * 9 and told[3] is None
    assert decontaminate.decontaminate(docs, items.limit(0), remove="spans").count() == len(TEXTS)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_no_rows(spark, stage):
    """Every stage on rows with nulls, repeats and clashing columns, and on none."""
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = table.limit(20)
    docs = first.union(first.limit(2)).union(spark.createDataFrame([(None,) * 5, (10**6, "", None, None, 0)], table.schema))
    docs = docs.withColumnsRenamed({"lang": "mix_key", "n_chars": "toxicity"})
    run = dict(corpus_pipeline.STAGES)[stage]
    made = run(spark, docs, SF_DIR)
    assert made.columns == docs.columns and made.count() > 0
    assert run(spark, docs.limit(0), SF_DIR).count() == 0


def test_lines_of_one_document_do_not_recur(spark):
    """Three lines of one template in one document are one document; with two more documents they recur."""
    base = "alpha beta gamma one two three four five six "
    rows = [(1, "\n".join(base + w for w in "xyz")), (2, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in templates.find_recurring_lines(docs).collect()} == {1: [], 2: []}
    more = docs.union(spark.createDataFrame([(3, base + "u"), (4, "head\n" + base + "v")], docs.schema))
    assert {r.doc_id: r.dropped for r in templates.find_recurring_lines(more).collect()} == {1: [0, 1, 2], 2: [], 3: [0], 4: [1]}
    repeated = docs.union(docs).union(docs)
    assert [r.dropped for r in templates.find_recurring_lines(repeated).collect()].count([0, 1, 2]) == 3


def test_later_families_of_a_leaf_are_templates(spark):
    """A commoner line leads the leaf; the families that are unlike it recur as well, however many elections it takes."""
    base = "aa bb cc "
    families = ["d e f g h i", "k l m n o p", "q r s t u v"]
    rows = [(10 * k + j, f"{base}{words} w{'xyzu'[j]}") for k, words in enumerate(families) for j in range(4)]
    rows += [(100 + j, f"{base}{families[0]} wx") for j in range(5)] + [(200, base + "1 2 3 4 5 6 7"), (201, base + "alone a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.dropped for r in templates.find_recurring_lines(docs).collect()}
    assert found == {i: [] if i >= 200 else [0] for i, _ in rows}
    lines = templates.line_templates(docs).select("first", "template").distinct().collect()
    assert len({r.first for r in lines}) == 3 and sum(r.template.endswith("<*>") for r in lines) == 3
    # One leader at a time finds the same as many at once, and as all lines one after the other.
    words = [f"{base}{' '.join('pqr'[(i >> s) % 3] for s in range(7))}" for i in range(1 << 9)]
    counted = spark.createDataFrame([(w, 1 + i % 4, 10, "aa bb cc") for i, w in enumerate(sorted(set(words)))], "masked string, docs long, n int, lead string")
    leaders, expected = [], {}
    for r in sorted(counted.collect(), key=lambda r: (-r.docs, r.masked)):
        like = [x for x in leaders if sum(a == b for a, b in zip(x.split(), r.masked.split())) >= 7]
        leaders += [] if like else [r.masked]
        expected[r.masked] = like[0] if like else r.masked
    assert len(leaders) > 5
    for at_once in (3, 256):
        assert {r.masked: r["first"] for r in templates._grouped(counted, 1, 0.7, at_once).collect()} == expected
