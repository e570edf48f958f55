"""A training corpus from `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents
with their columns. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import free_name, materialize, shared_path
from emberlog.llm.decontaminate import decontaminate
from emberlog.llm.mixing import mix_sources
from emberlog.llm.queries import END_ID, TOXIC_FROM, tokenizer_path
from emberlog.llm.simhash import drop_near_copies
from emberlog.llm.tokens import token_digest, write_tokens
from emberlog.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on those that `labels` covers."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "toxicity")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return drop_near_copies(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, remove="documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws, in a global random order."""
    return mix_sources(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in the order in which they come, read back document by document."""
    out = shared_path(spark, "corpus-tokens")
    write_tokens(docs, out, tokenizer_path(), END_ID, sort=False)
    return token_digest(spark, out)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_output", token_output),
]

# A trained network and a tokenizer are stages that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
