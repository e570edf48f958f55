"""The registered queries that SQL cannot express, and the pipeline, against brute force."""

import os
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: plain.encode(text or "", add_special_tokens=False).ids + [queries.END_ID]


def test_simhash(spark, rows):
    assert sorted(map(tuple, queries.op2_simhash(spark, SF_DIR).collect())) == sorted(brute.simhash(rows))


def test_suffix_array_dedup(spark, rows):
    made = queries.op7_suffix_array_dedup(spark, SF_DIR).collect()
    assert sorted(map(tuple, made)) == sorted(brute.byte_windows(rows))


def test_token_output(spark, rows, encode):
    expected, start = [], 0
    for i, text in sorted(rows):
        ids = encode(text)
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op8_token_output(spark, SF_DIR).collect())) == expected


def test_toxicity(spark, rows):
    made = queries.op10_toxicity(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in made) == sorted(i for i, _ in rows)
    for r in made:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_pipeline_stages(spark, rows, encode, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "token_output":
            assert docs.columns == documents.columns
            kept[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    scored = {r["doc_id"]: r["score"] for r in queries.op10_toxicity(spark, SF_DIR).collect()}
    assert sorted(kept["toxicity"]) == sorted(r for r in rows if scored[r[0]] < 0.3)
    one = [r for r, (i, _, component) in zip(kept["toxicity"], brute.simhash(kept["toxicity"])) if i == component]
    assert sorted(kept["simhash_near_dedup"]) == sorted(one)
    clean = [r for r, hit in zip(one, brute.contamination(one, items)) if not hit[-1]]
    assert sorted(kept["benchmark_decontamination"]) == sorted(clean)
    assert set(kept["source_mixing"]) <= set(clean)
    told = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in docs.collect())
    expected = [(i, encode(t)) for i, t in kept["source_mixing"]]
    assert told == sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in expected)
    spans = sorted((r["start"], r["n_tokens"]) for r in docs.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def test_run(spark):
    made = corpus_pipeline.run(spark, SF_DIR).agg(F.count("*"), F.min("start")).head()
    assert made[0] > 0 and made[1] == 0
