"""The operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import alignment, chat, decontaminate, exact, language, mixing, oracles, ranked, simhash
from emberlog.llm import substrings, suffixes, templates, tokens, toxicity
from emberlog.llm.common import shared_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_read(spark, sf_dir, "documents")).drop("n_chunks")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(_read(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.find_recurring_lines(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_lines",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.transform("dropped", lambda i: i.cast("string")), ",").alias("dropped_lines"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_copies", "mix_copy", "mix_key")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substrings.drop_repeated_words(_read(spark, sf_dir, "documents"), window=50)
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffixes.drop_repeated_bytes(_read(spark, sf_dir, "documents"), length=100)
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return made.select("doc_id", "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"))


# The end of a text in the token files, and the vocabulary file's name among the public ones.
END_ID, VOCABULARY = 1, "word_bpe_49k.json"
# The two that are aligned.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Where a vocabulary file lies, on the driver as on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "tokens")
    tokens.write_tokens(_read(spark, sf_dir, "documents"), out, tokenizer_path(), END_ID)
    return tokens.token_digest(spark, out)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    made = chat.format_chats(rows.unionByName(extra))
    loss = chat.loss_text(F.col("segments"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        "n_turns",
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


# Scores from here on count as toxic.
TOXIC_FROM = 0.3


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    made = language.predict_language(docs, language.fit_language(docs))
    return made.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    made = alignment.align_tokenizers(docs, tokenizer_path(BYTE_LEVEL), tokenizer_path(PIECES))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return made.withColumn("groups_sha256", digest).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_output": op8_token_output,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_toxicity": op10_toxicity,
    "op11_language": op11_language,
    "op12_ranked_search": op12_ranked_search,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": oracles.EXACT,
    "op3_line_dedup": oracles.LINES,
    "op4_mixing": oracles.MIXING,
    "op5_decontamination": oracles.CONTAMINATION,
    "op6_substring_dedup": oracles.WORD_WINDOWS,
    "op9_chat_formatting": oracles.CHATS,
    "op12_ranked_search": oracles.RANKED,
}
