"""Toxicity by a convolutional text classifier trained in numpy.

Each word is the mean of four hashed embeddings: the word and its first four, five and six characters,
so that unseen endings of a known stem still count. Filters of widths 1, 2 and 3 slide over a document,
ReLU and max pooling over the whole text give one number per filter, and a logistic unit the score. No
input but the text enters a score.

Training takes a bounded sample of labelled rows (`rows`, a parameter; texts over `longest` characters
are left out of the sample, never of scoring), chosen by a hash of the id, a third of them toxic where
there are so many. It runs on the driver; the model is a few megabytes of fixed size and is broadcast.
Thresholds are then chosen for each language on a quarter of the sample that training did not see; a
language with under 20 toxic rows there takes the threshold of all.

Defined results: a null text counts as empty; an empty text gets the score of padding alone; without
labels of both kinds every score is 0 and nothing is flagged. A doc_id labelled twice counts as toxic if
one label says so; of rows that share a doc_id the first by text is learned from. Columns of other names pass through; outputs replace equal names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fold, table, text_of

BUCKETS = 1 << 15
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Words whose filter responses are held at once when scoring.
WORDS_AT_ONCE = 200_000
EDGE = ".,;:!?|()[]{}<>\"'`*#$%&-_"


def word_buckets(word: str) -> tuple[int, int, int, int]:
    word = word.lower().strip(EDGE)
    return tuple([zlib.crc32(x.encode()) % BUCKETS for x in (word, "4" + word[:4], "5" + word[:5], "6" + word[:6])])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words (a row of four each), the words of all texts as places in them, and the texts' ends."""
    words = pc.ascii_split_whitespace(texts)
    coded = words.values.dictionary_encode()
    buckets = np.array([word_buckets(w) for w in coded.dictionary.to_pylist()], dtype=np.int32).reshape(-1, 4)
    return buckets, np.asarray(coded.indices, dtype=np.int32), np.asarray(words.offsets, dtype=np.int64)


@dataclass
class Model:
    embeddings: np.ndarray  # BUCKETS x SIZE
    filters: list[np.ndarray]  # for each width: width x SIZE x FILTERS
    biases: np.ndarray  # len(WIDTHS) * FILTERS
    out: np.ndarray
    bias: float
    thresholds: dict[str, float]
    threshold: float

    def pooled(self, responses: list[list[np.ndarray]], words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum over each text of each filter, and where it stands. words, starts: from pad(). A filter starts at a word of the text (at padding if there is none)."""
        best, where = [], []
        ends = np.maximum(np.append(starts[1:], len(words)) - len(WIDTHS), starts + 1)
        spans = np.stack([starts, ends], axis=1).ravel()
        for width, tables in zip(WIDTHS, responses, strict=True):
            total = tables[0][words]
            for j in range(1, width):
                total[:-j] += tables[j][words[j:]]
            best.append(np.maximum.reduceat(total, spans, axis=0)[::2])
            if len(starts) <= 64:
                where.append(np.stack([a + total[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)]))
        return np.concatenate(best, axis=1), np.concatenate(where, axis=1) if where else np.zeros(0)

    def responses(self, buckets: np.ndarray) -> list[list[np.ndarray]]:
        """What each distinct word, and padding, adds to each filter at each of its places."""
        vectors = np.concatenate([self.embeddings[buckets].mean(axis=1), np.zeros((1, SIZE), np.float32)])
        return [[vectors @ part for part in weights] for weights in self.filters]

    def scores(self, buckets: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        responses, out = self.responses(buckets), []
        row, n = 0, len(offsets) - 1
        while row < n:
            upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + WORDS_AT_ONCE, side="right")) - 1)
            padded, starts = pad(words, offsets[row : upto + 1], len(buckets))
            best, _ = self.pooled(responses, padded, starts)
            out.append(np.maximum(best + self.biases, 0) @ self.out + self.bias)
            row = upto
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30))) if out else np.zeros(0)


def pad(words: np.ndarray, offsets: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts between the offsets with len(WIDTHS) blanks after each, so that no filter reaches the next text, and their starts."""
    sizes, gap = np.diff(offsets), len(WIDTHS)
    ends = np.cumsum(sizes + gap)
    starts = ends - sizes - gap
    padded = np.full(int(ends[-1]), blank, dtype=np.int32)
    padded[np.repeat(starts - (offsets[:-1] - offsets[0]), sizes) + np.arange(int(sizes.sum()))] = words[offsets[0] : offsets[-1]]
    return padded, starts


def fit(texts: list[str], labels: np.ndarray, languages: list[str], epochs: int = 8, rate: float = 0.05, seed: int = 0) -> Model | None:
    """The model from labelled texts; None unless both labels occur."""
    if not len(labels) or labels.min() == labels.max():
        return None
    buckets, words, offsets = tokens(pa.array(texts, pa.string()))
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.25
    if labels[~held].min() == labels[~held].max():
        held[:] = False
    # one dimension starts at each bucket's log odds, the rest at noise
    counts = np.ones((2, BUCKETS))
    for i in np.flatnonzero(~held):
        seen = np.unique(buckets[words[offsets[i] : offsets[i + 1]]])
        counts[int(labels[i]), seen] += 1
    share = counts / (np.array([(labels[~held] == k).sum() for k in (0, 1)])[:, None] + 2)
    embeddings = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    embeddings[:, 0] = np.clip(np.log(share[1] / share[0]), -3, 3)
    filters = [rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, 0] += 1.0
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    out[:: FILTERS] += 1.0
    model = Model(embeddings, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), out, -3.0, {}, 0.5)
    squares = [np.full_like(embeddings, 1e-4), [np.full_like(f, 1e-4) for f in filters], np.full_like(model.biases, 1e-4), np.full_like(out, 1e-4), 1e-4]
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            parts = [words[offsets[i] : offsets[i + 1]] for i in rows]
            local, places = np.unique(np.concatenate(parts), return_inverse=True) if sum(map(len, parts)) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            padded, starts = pad(places.astype(np.int32), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), len(local))
            best, where = model.pooled(model.responses(buckets[local]), padded, starts)
            hidden = np.maximum(best + model.biases, 0)
            score = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.bias, -30, 30)))
            error = ((score - labels[rows]) / len(rows)).astype(np.float32)
            slope = np.outer(error, model.out) * (hidden > 0)
            vectors = np.concatenate([model.embeddings[buckets[local]].mean(axis=1), np.zeros((1, SIZE), np.float32)])
            to_words = np.zeros((len(local) + 1, SIZE), np.float32)
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                change = np.zeros_like(model.filters[k])
                for j in range(width):
                    at_word = padded[np.minimum(where[:, cols] + j, len(padded) - 1)]
                    change[j] = np.einsum("rfs,rf->sf", vectors[at_word], slope[:, cols])
                    np.add.at(to_words, at_word.ravel(), (slope[:, cols, None] * model.filters[k][j].T[None]).reshape(-1, SIZE))
                squares[1][k] += change**2
                model.filters[k] -= rate * change / np.sqrt(squares[1][k])
            for value, change, k in ((model.biases, slope.sum(axis=0), 2), (model.out, hidden.T @ error, 3)):
                squares[k] += change**2
                value -= rate * change / np.sqrt(squares[k])
            squares[4] += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / squares[4] ** 0.5
            hit = np.flatnonzero(np.abs(to_words[:-1]).sum(axis=1))
            target = buckets[local[hit]].ravel()
            change = np.repeat(to_words[hit] / 4, 4, axis=0)
            np.add.at(squares[0], target, change**2)
            np.add.at(model.embeddings, target, -rate * change / np.sqrt(squares[0][target]))
    if held.any():
        unseen = tokens(pa.array([texts[i] for i in np.flatnonzero(held)], pa.string()))
        model.threshold, model.thresholds = calibrated(model.scores(*unseen), labels[held], np.array(languages, dtype=object)[held])
    return model


def calibrated(scores: np.ndarray, labels: np.ndarray, languages: np.ndarray, least: int = 20) -> tuple[float, dict[str, float]]:
    """The threshold with the best F1 of all rows, and of each language with enough toxic rows; the middle one of equals."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        tries = np.linspace(0.05, 0.95, 91)
        found = np.array([2 * (y[s >= t]).sum() / max(1, (s >= t).sum() + y.sum()) for t in tries])
        top = tries[found >= found.max() - 1e-12]
        return float(top[np.abs(top - 0.5).argmin()])

    all_of = best(scores, labels) if labels.sum() >= least else 0.5
    return all_of, {str(g): best(scores[m], labels[m]) for g in set(languages) if g is not None and labels[m := languages == g].sum() >= least}


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, longest: int = 20_000, learn: Column | None = None) -> Model | None:
    """Fit on at most `rows` labelled documents (a third toxic). learn: which labelled rows may be used."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(learn) if learn is not None else known
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("toxic = 1").orderBy(*order).limit(rows // 3).unionByName(known.filter("toxic = 0").orderBy(*order).limit(rows - rows // 3))
    language = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    fitting = docs.select("doc_id", text_of().alias("text"), language.alias("lang")).filter(F.length("text") <= longest)
    # the sample has at most `rows` rows of two numbers; of rows that share a doc_id one reaches the driver
    each = fitting.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row"), F.max("toxic").alias("toxic"))
    found = each.select("doc_id", "row.text", "row.lang", "toxic").toPandas().sort_values("doc_id")
    return fit(found["text"].tolist(), found["toxic"].to_numpy(dtype=np.float64), found["lang"].tolist())


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """df with the double column `out`, 0 to 1, over whole texts."""
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(shared.value.scores(*tokens(texts.slice(at, 1024))), pa.float64()) for at in range(0, len(texts), 1024)] or [pa.array([], pa.float64())])

    return df.withColumn(out, score_of(text_of(text)))


def flag(df: DataFrame, model: Model | None, out: str = "flagged") -> DataFrame:
    """df (with score and lang) and a boolean column: the score reaches the threshold of the language."""
    if model is None:
        return df.withColumn(out, F.lit(False))
    limit = F.lit(model.threshold)
    for language, at in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == language, F.lit(at)).otherwise(limit)
    return df.withColumn(out, F.col("score") >= limit)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored: doc_id, held_out, score, predicted, flagged (by the language's threshold)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, learn=fold("doc_id", 5) != 0)
    scored = flag(score(docs.select("doc_id", "text", "lang"), model), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
