"""Toxicity by a bidirectional gated recurrent network with attention pooling."""

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import import_path

WINDOW, STRIDE = 48, 32
HIDDEN, FEATURES = 8, 8
BUCKETS = 1 << 18
GRAMS = (3, 4, 5, 6)
EDGES = b".,;:!?\"'()[]{}<>*-_=/\\"
# Bounds of the sample that the model is fitted on: rows of either label, windows of a clean row.
MOST_TOXIC, MOST_CLEAN, CLEAN_WINDOWS = 2000, 4000, 3
FOLDS, EPOCHS, BATCH, RATE = 4, 8, 128, 0.01
# Windows scored at once, words looked up at once, and words whose features a worker keeps: most words
# of a corpus are rare. A lexicon takes 60 times the bytes of its words, so both have bounds in bytes too.
SCORED, WORDS_AT_ONCE, KNOWN_WORDS = 2048, 1 << 16, 1 << 16
LEXICON_BYTES, KNOWN_BYTES = 1 << 19, 1 << 23


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def window_starts(n: int) -> range:
    """Where the windows of n words start: each overlaps the one before, and all words are in one."""
    return range(0, max(n - WINDOW + STRIDE, 1), STRIDE)


class Lexicon:
    """Hashed ids of words and of their character n-grams; ^ and $ stand for a word's ends."""

    def __init__(self, words: list[bytes]):
        bare = [w.strip(EDGES) or w for w in words]
        self.word = np.array([zlib.crc32(w) % BUCKETS for w in bare], np.int32)
        self.length = np.array([len(w) for w in bare], np.int64)
        inside = np.frombuffer(b"^" + b"$^".join(bare) + b"$", np.uint8).astype(np.uint64)
        begins = np.cumsum(self.length + 2) - self.length - 2
        self.grams, self.counts = [], []
        for n in GRAMS:
            places = max(len(inside) - n + 1, 0)
            mixed = np.zeros(places, np.uint64)
            for k in range(n):
                mixed = mixed * np.uint64(0x100000001B3) + inside[k : k + places] + np.uint64(n)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 18)
            counts = np.maximum(self.length + 3 - n, 0)
            self.grams.append(mixed.astype(np.int32)[_ranges(begins, counts)])
            self.counts.append(counts)

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word ids and n-gram ids of some words."""
        grams = [g[_ranges((np.cumsum(c) - c)[rows], c[rows])] for g, c in zip(self.grams, self.counts)]
        return np.unique(self.word[rows]), np.unique(np.concatenate(grams))


def _parts(words: list[bytes]) -> Iterator[list[bytes]]:
    """Words in parts of at most LEXICON_BYTES; a longer word is a part of its own."""
    part, size = [], 0
    for w in words:
        if part and size + len(w) > LEXICON_BYTES:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of them, one range after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Counts:
    """How many documents of either label hold each word and each n-gram, per fold."""

    def __init__(self):
        self.documents = np.zeros((FOLDS, 2), np.int64)
        self.held = np.zeros((2, FOLDS, 2, BUCKETS), np.int32)

    def add(self, ids: tuple[np.ndarray, np.ndarray], fold: int, label: int) -> None:
        """A document's distinct word ids and n-gram ids."""
        self.documents[fold, label] += 1
        for part in (0, 1):
            self.held[part, fold, label, ids[part]] += 1

    def odds(self, without: int | None = None) -> "Odds":
        """Odds over all documents, or over those of the other folds."""
        rest = np.array([k for k in range(FOLDS) if k != without])
        n = self.documents[rest].sum(axis=0) + 1.0
        smooth, out = 0.5 * n / n.sum(), []
        for part in (0, 1):
            df = self.held[part, rest].sum(axis=0, dtype=np.float64)
            out.append(np.log((df[1] + smooth[1]) / n[1]) - np.log((df[0] + smooth[0]) / n[0]))
        return Odds(*(np.clip(x, -4, 6).astype(np.float32) for x in out))


@dataclass
class Odds:
    """Log odds of toxic against clean documents for each word and each n-gram."""

    word: np.ndarray
    gram: np.ndarray

    def features(self, lexicon: Lexicon) -> np.ndarray:
        """What the network sees of each word: its own odds, and the odds of its characters."""
        n = len(lexicon.word)
        rows = np.zeros((n, FEATURES), np.float32)
        rows[:, 0] = self.word[lexicon.word]
        total, least = np.zeros(n, np.float32), np.full(n, np.inf, np.float32)
        for k, (grams, counts) in enumerate(zip(lexicon.grams, lexicon.counts)):
            has = np.flatnonzero(counts)
            if not len(has):
                continue
            odds, at = self.gram[grams], (np.cumsum(counts) - counts)[has]
            rows[has, 1 + k] = np.maximum.reduceat(odds, at)
            total[has] += np.add.reduceat(odds, at)
            least[has] = np.minimum(least[has], np.minimum.reduceat(odds, at))
        rows[:, 5] = total / np.maximum(sum(lexicon.counts), 1)
        rows[:, 6] = np.where(np.isinf(least), 0, least)
        rows[:, 7] = np.minimum(lexicon.length, 20) / 10
        return rows / np.float32(3)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """The network's weights; plain numpy, forward and backward."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, FEATURES
        self.p = {}
        for way in "fb":
            self.p[f"W{way}"] = rng.normal(0, d**-0.5, (d, 3 * h))
            self.p[f"U{way}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            self.p[f"b{way}"] = np.zeros(3 * h)
        self.p |= {"v": rng.normal(0, 0.3, 2 * h), "w": rng.normal(0, 0.3, 2 * h), "c": np.array([-1.0])}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _pass(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        w, u, b = (self.p[k + way] for k in "WUb")
        h2, steps = 2 * HIDDEN, len(x)
        state, out = np.zeros((x.shape[1], HIDDEN), np.float32), np.empty((*x.shape[:2], HIDDEN), np.float32)
        given = x.reshape(-1, FEATURES) @ w + b
        given = given.reshape(steps, x.shape[1], 3 * HIDDEN)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a, own = given[t], state @ u
            gates = _sigmoid(a[:, :h2] + own[:, :h2])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(a[:, h2:] + r * own[:, h2:])
            if keep is not None:
                keep.append((t, r, z, new, own[:, h2:], state))
            state = (new + z * (state - new)) * mask[t]
            out[t] = state
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; x is (words, windows, features), mask (words, windows, 1)."""
        kept = {way: [] if keep is not None else None for way in "fb"}
        states = np.concatenate([self._pass(x, mask, way, kept[way]) for way in "fb"], axis=2)
        score = np.where(mask[..., 0] > 0, states @ self.p["v"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if keep is not None:
            keep |= {"kept": kept, "states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        logit = self.forward(x, mask, keep)
        off = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        states, weight, pooled = keep["states"], keep["weight"], keep["pooled"]
        g = {"c": off.sum(keepdims=True), "w": pooled.T @ off}
        d_pooled = off[:, None] * self.p["w"]
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tbh,tb->h", states, d_score)
        d_states = weight[..., None] * d_pooled + d_score[..., None] * self.p["v"]
        for k, way in enumerate("fb"):
            u = self.p[f"U{way}"]
            gw, gu, gb = (np.zeros_like(self.p[n + way]) for n in "WUb")
            carried = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, r, z, new, own_new, before in reversed(keep["kept"][way]):
                d = (d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carried) * mask[t]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * own_new * r * (1 - r)
                d_given = np.concatenate((d_r, d_z, d_new), axis=1)
                d_own = np.concatenate((d_r, d_z, d_new * r), axis=1)
                gw += x[t].T @ d_given
                gb += d_given.sum(axis=0)
                gu += before.T @ d_own
                carried = d * z + d_own @ u.T
            g[f"W{way}"], g[f"U{way}"], g[f"b{way}"] = gw, gu, gb
        return g

    def fit(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(a) for k, a in self.p.items()}
        s = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(label))
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                for k, g in self.gradients(x[:, pick], mask[:, pick], label[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    move = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = (self.p[k] - move).astype(np.float32)


def _windows(rows: np.ndarray, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Features (WINDOW, windows, FEATURES) and mask of the windows of one document's feature rows."""
    x = np.zeros((WINDOW, len(starts), FEATURES), np.float32)
    mask = np.zeros((WINDOW, len(starts), 1), np.float32)
    for k, s in enumerate(starts):
        part = rows[s : s + WINDOW]
        x[: len(part), k], mask[: len(part), k] = part, 1
    return x, mask


@dataclass
class Model:
    odds: Odds
    network: Network
    base: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def fit(texts: list[bytes], labels: list[int]) -> "Model":
        """Fit odds and network. Windows are shown with odds that their own fold had no part in.

        A toxic document teaches with its most suspicious window, a clean one with that and some
        others. With only one label, or none, everything scores the base rate.
        """
        known: dict[bytes, int] = {}
        indices = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int32) for t in texts]
        del texts
        lexicon = Lexicon(list(known))
        known.clear()
        counts = Counts()
        for k, (index, label) in enumerate(zip(indices, labels)):
            counts.add(lexicon.ids_of(np.unique(index)), k % FOLDS, label)
        base = (sum(labels) + 0.5) / (len(labels) + 5.0)
        network = Network()
        if len(set(labels)) == 2:
            xs, masks, ys = [], [], []
            for fold in range(FOLDS):
                table = counts.odds(fold).features(lexicon)
                for k in range(fold, len(indices), FOLDS):
                    if not len(indices[k]):
                        continue
                    rows = table[indices[k]]
                    starts = list(window_starts(len(rows)))
                    suspicion = [np.sort(rows[s : s + WINDOW, [0, 3, 4]].sum(axis=1))[-3:].sum() for s in starts]
                    chosen = [starts[int(np.argmax(suspicion))]]
                    if not labels[k]:
                        chosen = sorted({*chosen, *starts[:: max(1, len(starts) // (CLEAN_WINDOWS - 1) + 1)]})
                    x, mask = _windows(rows, chosen)
                    xs.append(x)
                    masks.append(mask)
                    ys += [labels[k]] * len(chosen)
            network.fit(np.concatenate(xs, axis=1), np.concatenate(masks, axis=1), np.array(ys, np.float32))
            return Model(counts.odds(), network, base)
        none = np.zeros(BUCKETS, np.float32)
        network.p["w"][:] = 0
        network.p["c"][:] = np.log(base / (1 - base))
        return Model(Odds(none, none), network, base)


class Scorer:
    """Scores texts with a model, keeping the features of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.known_bytes = 0
        self.table = np.zeros((1 << 12, FEATURES), np.float32)

    def _indices(self, words: list[bytes]) -> np.ndarray:
        """Rows of the feature table, from 1; row 0 is padding."""
        if len(self.rows) > KNOWN_WORDS or self.known_bytes > KNOWN_BYTES:
            self.forget()
        rows = self.rows
        found = list(map(rows.get, words))
        if None in found:
            new = list({w for w, i in zip(words, found) if i is None})
            at = len(rows) + 1
            while at + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            for part in _parts(new):
                self.table[at : at + len(part)] = self.model.odds.features(Lexicon(part))
                rows.update(zip(part, range(at, at + len(part))))
                at += len(part)
            self.known_bytes += sum(map(len, new))
            found = list(map(rows.get, words))
        return np.array(found, np.int32)

    def _logits(self, index: np.ndarray) -> np.ndarray:
        """Logits of windows of table rows, WINDOW of them each, some windows at a time."""
        out = np.empty(len(index))
        for at in range(0, len(index), SCORED):
            part = index[at : at + SCORED].T
            out[at : at + SCORED] = self.model.network.forward(self.table[part], (part > 0).astype(np.float32)[..., None])
        return out

    def score(self, texts: Iterator[bytes | None], n: int) -> np.ndarray:
        """The greatest score of each text's windows; a text without words has the base rate."""
        scores = np.full(n, -np.inf)
        owners: list[int] = []
        sizes: list[int] = []
        held: list[bytes] = []

        def flush() -> None:
            whole, windows, of = self._indices(held), [], []
            begin = 0
            for owner, size in zip(owners, sizes):
                last = window_starts(size)[-1]
                padded = np.zeros(last + WINDOW, np.int32)
                padded[:size] = whole[begin : begin + size]
                begin += size
                windows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
                of.append(np.full(len(windows[-1]), owner))
            np.maximum.at(scores, np.concatenate(of), self._logits(np.concatenate(windows)))

        for k, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            owners.append(k)
            sizes.append(len(words))
            held += words
            if len(held) >= WORDS_AT_ONCE:
                flush()
                owners, sizes, held = [], [], []
        if held:
            flush()
        return np.where(np.isneginf(scores), self.model.base, 1 / (1 + np.exp(-np.clip(scores, -50, 50))))


_SCORERS: dict[str, Scorer] = {}


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN
) -> tuple[list[bytes], list[int]]:
    """A bounded sample of labelled texts, least hashed ids first.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out and never taken. Of rows with one id
    the least text is taken, once.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.max("label").alias("label"))
    taken = None
    for label, most in ((1, most_toxic), (0, most_clean)):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
        taken = part if taken is None else taken.unionByName(part)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # At most most_toxic + most_clean rows of an id and a label.
    rows = own.join(F.broadcast(taken), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = sorted((r["doc_id"], bytes(r["text"] or b""), r["label"]) for r in rows.toLocalIterator())
    return [t for _, t, _ in sample], [y for _, _, y in sample]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_toxic: int = MOST_TOXIC,
    most_clean: int = MOST_CLEAN,
) -> Model:
    """Fit a model on the labelled rows of docs that are not held out, in a bounded sample.

    At most `most_toxic` and `most_clean` documents. Labels other than 0 and 1 and null ids teach
    nothing; an id with both labels is toxic. Null texts are empty. Without rows, or with one
    label only, every text scores the base rate.
    """
    return Model.fit(*training_rows(docs, labels, id_col, text_col, most_toxic, most_clean))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with `score_col`, 0 to 1, the greatest score among all overlapping windows of a text.

    Only the text is looked at. Null and empty texts have the base rate of the sample. Repeated
    rows score alike. Long texts are scored window by window, all of them. All columns come back
    as they are, so `score_col` has to be a name that docs has not (`free_name` finds one). Without
    rows no rows come.
    """
    if score_col in docs.columns:
        raise ValueError(f"docs has a column {score_col} already")
    import_path(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the data

    @F.pandas_udf(T.DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        scorer = _SCORERS.get(own.name)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[own.name] = Scorer(own)
        for column in texts:
            yield pd.Series(scorer.score(iter(column), len(column)))

    return docs.withColumn(score_col, scored(F.col(text_col).cast("binary")))
