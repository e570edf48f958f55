"""Language of a text: its family first, then the closest languages of that family apart."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import import_path, materialize
from emberlog.llm.toxicity import held_out

# Families of language codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn mr ne pa gu or as sd ur",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
}
# Words without letters have no language.
UNKNOWN = "und"
# Buckets of hashed n-grams, their sizes in bytes, and bytes taken at once.
BUCKETS, GRAMS, BYTES_AT_ONCE = 1 << 13, (1, 2, 3, 4), 1 << 20
# Bounds of the sample that the machines are fitted on: languages, the most frequent ones, and rows on
# either side of a machine. (Up to 1000 rows, Spark's top rows per group are cut before the shuffle.)
MOST_LANGUAGES, ROWS = 64, 600
STEPS, PENALTY, SLOPE = 300, 1e-4, 2.0
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def family_of(language: str) -> str:
    """A language's family; one of an unlisted code is a family of its own."""
    return next((family for family, codes in FAMILIES.items() if language in codes.split()), language)


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of a text's words, bytes of lower case, with a space at their ends."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), BYTES_AT_ONCE):
        # Every n-gram that begins here, with the bytes it needs from further on.
        part = np.frombuffer(data[at : at + BYTES_AT_ONCE + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        mixed = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            begins = min(BYTES_AT_ONCE, len(part) - n + 1)
            if begins <= 0:
                break
            mixed = mixed[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            if n in GRAMS:
                shown = (mixed[:begins] ^ mixed[:begins] >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(32 - 13)
                counts += np.bincount(shown, minlength=BUCKETS)
    return counts


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts as rows of length 1, and a constant."""
    rows = np.sqrt(counts.astype(np.float32))
    rows /= np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), np.float32(1e-9))
    return np.concatenate((rows, np.ones((len(rows), 1), np.float32)), axis=1)


def fit_machine(rows: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine, side 1 against 0, by accelerated gradients.

    The squared hinge loss of both sides weighs the same, however many rows each has. With one
    side only, everything is on that side.
    """
    sign = np.where(side == 1, 1, -1).astype(np.float32)
    if len(set(sign.tolist())) < 2:
        weights = np.zeros(rows.shape[1], np.float32)
        weights[-1] = sign[0] if len(sign) else 0
        return weights
    share = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum()).astype(np.float32)
    # Rows have length sqrt(2), so this is at most the inverse of the gradient's steepest change.
    rate = np.float32(1 / (4 + PENALTY))
    weights = ahead = np.zeros(rows.shape[1], np.float32)
    pace = 1.0
    for _ in range(STEPS):
        missing = np.maximum(1 - sign * (rows @ ahead), 0)
        gradient = np.float32(PENALTY) * ahead - 2 * rows.T @ (share * sign * missing)
        new = ahead - rate * gradient
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = (new + np.float32((pace - 1) / after) * (new - weights)).astype(np.float32)
        weights, pace = new, after
    return weights


@dataclass
class Model:
    """Machines one against one: between families, and between the languages of each."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _chosen(self, group: str, members: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which member wins each row, and the mean probability against the others."""
        if len(members) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        votes = np.zeros((len(margins), len(members)))
        for k, (own, a, b) in enumerate(self.pairs):
            if own == group:
                p = 1 / (1 + np.exp(-np.clip(SLOPE * margins[:, k], -50, 50)))
                votes[:, members.index(a)] += p
                votes[:, members.index(b)] += 1 - p
        best = votes.argmax(axis=1)
        return best, votes.max(axis=1) / (len(members) - 1)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of counts."""
        margins = unit_rows(counts) @ self.weights.T
        families = sorted(self.families)
        family, sure = self._chosen("", families, margins)
        languages, scores = np.full(len(counts), UNKNOWN, object), np.zeros(len(counts))
        for k, name in enumerate(families):
            rows = np.flatnonzero(family == k)
            members = sorted(self.families[name])
            language, surer = self._chosen(name, members, margins[rows])
            languages[rows] = np.array(members, object)[language]
            scores[rows] = sure[rows] * surer
        return languages.tolist(), scores


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_rows(docs: DataFrame, languages: dict[str, int], quota: dict[str, int], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, place, grams, counts: for each language the rows of least hashed ids, `quota` of them.

    `languages` has the rows of each language that may be taken. A language's rows are thinned by
    that hash before they are ranked, so the greatest is no larger a group than the others.
    """
    hashed = F.xxhash64(id_col, F.lit(5))
    share = F.create_map(*[x for l, n in languages.items() for x in (F.lit(l), F.lit((2 * quota[l] + 50) / n))])
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hashed.alias("hashed"), held_out(F.col(id_col)).alias("out"))
    rows = rows.where(~F.col("out") & _has_letter(F.col("text")) & F.col("lang").isin(list(languages)))
    rows = rows.where(F.pmod("hashed", F.lit(1 << 31)) < share[F.col("lang")] * (1 << 31))
    names = ["lang", "hashed", "grams", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [gram_counts(t.as_py()) for t in batch.column("text")]
            grams = [np.flatnonzero(c) for c in met]
            columns = [
                pa.array(grams, pa.list_(pa.int32())),
                pa.array([c[g] for c, g in zip(met, grams)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hashed"), *columns], names)

    counted = rows.select("lang", "text", "hashed").mapInArrow(run, "lang string, hashed long, grams array<int>, counts array<long>")
    order = Window.partitionBy("lang").orderBy("hashed", F.xxhash64("grams", "counts"))
    most = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(quota[l]))])
    ranked = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(quota.values()))
    return ranked.where(F.col("place") <= most[F.col("lang")]).select("lang", "place", "grams", "counts")


def fit_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = ROWS,
    most_languages: int = MOST_LANGUAGES,
) -> Model:
    """Fit on the rows with a language and a letter that are not held out, in a bounded sample.

    That is at most `rows` rows on either side of a machine, of the `most_languages` most
    frequent languages. Machines are fitted side by side, a task each; their weights, 32 KB each,
    come to the driver. Null languages, null texts and texts without letters teach nothing; rows
    that repeat are rows of their own; without rows the model knows no language.
    """
    import_path(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & _has_letter(F.col(text_col)))
    counted = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    languages = {r["lang"]: r["n"] for r in counted.orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()}
    families: dict[str, list[str]] = {}
    for language in sorted(languages):
        families.setdefault(family_of(language), []).append(language)
    pairs = [("", a, b) for a, b in combinations(sorted(families), 2)]
    pairs += [(f, a, b) for f in sorted(families) for a, b in combinations(families[f], 2)]
    if not pairs:
        return Model(families, [], np.zeros((0, BUCKETS + 1), np.float32))
    sample = materialize(training_rows(docs, languages, dict.fromkeys(languages, rows), id_col, text_col, lang_col), "language-sample")

    # A language takes part in the machines of its family, against each of its sisters, and as a
    # share of its family in the machines between families.
    parts: dict[str, list] = {language: [] for language in languages}
    for k, (group, a, b) in enumerate(pairs):
        for side, name in ((1, a), (0, b)):
            for language in [name] if group else families[name]:
                parts[language].append((k, side, rows if group else -(-rows // len(families[name]))))
    told = F.create_map(
        *[
            x
            for language, own in parts.items()
            for x in (
                F.lit(language),
                F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("machine", "side", "most"), p)]) for p in own]),
            )
        ]
    )
    shared = sample.withColumn("part", F.explode(told[F.col("lang")])).where(F.col("place") <= F.col("part.most"))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(group), BUCKETS), np.int32)
        for k, (grams, own) in enumerate(zip(group["grams"], group["counts"])):
            counts[k, grams] = own
        weights = fit_machine(unit_rows(counts), group["side"].to_numpy())
        return pd.DataFrame({"machine": [group["machine"].iloc[0]], "weights": [weights.astype("<f4").tobytes()]})

    shared = shared.select(F.col("part.machine").alias("machine"), F.col("part.side").alias("side"), "grams", "counts")
    made = shared.groupBy("machine").applyInPandas(fitted, "machine int, weights binary")
    weights = np.zeros((len(pairs), BUCKETS + 1), np.float32)
    for r in made.toLocalIterator():
        weights[r["machine"]] = np.frombuffer(r["weights"], "<f4")
    return Model(families, pairs, weights)


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    Only the text is looked at, all of it. The score is the mean probability of the family
    against the other families, times that of the language against its sisters. Null texts and
    texts without a letter are `und` with score 0, and so is every text if the model knows no
    language; with one language all others are that, with score 1. Equal votes go to the first by
    name. Ids are handed through, null ones too; rows that repeat have equal answers. Long texts
    are counted a part at a time. Other columns are not read. No rows give no rows.
    """
    import_path(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 32 KB a machine
    own = docs.select(F.col(id_col).alias("doc_id"), F.when(_has_letter(F.col(text_col)), F.col(text_col)).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                rows = [k for k, t in enumerate(texts) if t is not None]
                if rows and known.families:
                    found, sure = known.predict(np.stack([gram_counts(texts[k]) for k in rows]))
                    scores[rows] = sure
                    for k, language in zip(rows, found):
                        languages[k] = language
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(languages), pa.array(scores)], names)

    return own.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
