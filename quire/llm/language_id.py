"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the whole lower-cased text are hashed to ``2 ** bits`` features.  Document frequencies
come from all rows that may be learned from.  Weights are trained on a bounded sample of them (``most`` rows, an equal
share of each language, so that a rare one is learned too) with
follow-the-regularised-leader per-coordinate steps, whose L1 part leaves most weights zero and whose L2 part shrinks
the rest; a fifth of the sample is set aside to fit one temperature, which divides the logits before the softmax.

Defined results: a text that is null or has no letter is ``und`` with score 0; a row whose ``lang`` is null is scored
but not learned from; with no row to learn from every text with a letter is ``und`` too; repeated rows get equal
results; a null doc_id is not held out; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held_out, table
from quire.llm.sampling import sample_per_group

UNDETERMINED = "und"
BITS = 14
#: Rows of the training sample, at most, and of how many languages, the most frequent ones; each has an equal share.
MOST, MOST_LANGUAGES = 4000, 200
#: Under it a document's language counts as not identified.
LEAST_SCORE = 0.4
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, count), ascending: of the lower-cased text between two spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    one, two, three = _MULTIPLIERS
    hashes = [points * one]
    hashes.append(points[:-1] * two + hashes[0][1:] * three)
    if len(points) > 2:
        hashes.append(hashes[1][:-1] * two + hashes[0][2:] * one + three)
    counts = np.bincount(np.concatenate([h ^ (h >> np.uint32(15)) for h in hashes]) * one >> np.uint32(32 - bits), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def row(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Values of a TF-IDF row of length one."""
        x = np.log1p(counts) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def probabilities(self, text: str) -> np.ndarray:
        at, counts = features(text)
        z = (self.row(at, counts) @ self.weights[at] + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Sparse rows (features, values) and a last feature of 1, the bias's."""
    out = np.zeros((len(rows), width + 1))
    out[:, -1] = 1
    for i, (at, values) in enumerate(rows):
        out[i, at] = values
    return out


def follow_the_regularised_leader(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, classes: int, epochs: int = 8, batch: int = 32, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal: the closed-form minimum over all past gradients, with elastic-net penalties."""
    z, n, w = (np.zeros((width + 1, classes)) for _ in range(3))
    penalty = np.full((width + 1, 1), l1)
    penalty[-1] = 0  # the bias isn't penalised
    random = np.random.default_rng(5)
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(rows)), max(len(rows) // batch, 1)):
            x = dense([rows[i] for i in part], width)
            error = _softmax(x @ w)
            error[np.arange(len(part)), y[part]] -= 1
            g = x.T @ error / len(part)
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z += g - sigma * w
            n += g * g
            w = np.where(np.abs(z) <= penalty, 0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1], w[-1]


def calibrated_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        return -float(np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(40):
        if loss(a) < loss(b):
            high, b = b, a
            a = high - ratio * (high - low)
        else:
            low, a = a, b
            b = low + ratio * (high - low)
    return float(np.exp((low + high) / 2))


def _document_frequencies(rows: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Rows, and how many of them have each feature.  A task sends one count per feature at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[features(text, bits)[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], ["feature", "n"])

    sums = rows.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # 2^bits + 1 rows at most
    df = np.zeros(1 << bits)
    for feature, n in sums:
        if feature >= 0:
            df[feature] = n
    return next((n for feature, n in sums if feature < 0), 0), df


def train(docs: DataFrame, most: int = MOST, bits: int = BITS) -> Model:
    """Learns from rows of ``docs`` (doc_id, text, lang) that aren't held out and have text and lang."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    n, df = _document_frequencies(rows, bits)
    idf = np.log((1 + n) / (1 + df)) + 1

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text, bits) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([at.astype("<u2").tobytes() for at, _ in found], pa.binary()), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for _, c in found], pa.binary())], ["doc_id", "lang", "at", "counts"])

    chosen = sample_per_group(rows, "lang", ["doc_id", "text"], most, MOST_LANGUAGES).select("text", F.col("doc_id").cast("string").alias("doc_id"), "lang")
    # Repeated rows count once, so that a row that a third of all rows repeat doesn't fill the driver.
    sample = chosen.mapInArrow(featurise, "doc_id string, lang string, at binary, counts binary").dropDuplicates().collect()
    sample.sort(key=lambda r: (r["doc_id"] or "", r["at"], r["lang"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return Model([], idf, np.zeros((1 << bits, 0)), np.zeros(0), 1.0)
    blank = Model(languages, idf, np.zeros((0, 0)), np.zeros(0), 1.0)
    decoded = ((np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u2")) for r in sample)
    x = [(at, blank.row(at, counts).astype(np.float32)) for at, counts in decoded]
    y = np.array([languages.index(r["lang"]) for r in sample])
    learn, aside = (np.flatnonzero((np.arange(len(y)) % 5 == 4) == which) for which in (False, True))
    weights, bias = follow_the_regularised_leader([x[i] for i in learn], y[learn], 1 << bits, len(languages))
    logits = np.array([x[i][1] @ weights[x[i][0]] + bias for i in aside])
    temperature = calibrated_temperature(logits, y[aside]) if len(aside) and len(languages) > 1 else 1.0
    return Model(languages, idf, weights, bias, temperature)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the features and languages alone

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` (any columns, text among them) whose language is determined with ``least_score`` or more."""
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x) for x in batch.column(text).to_pylist()]
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
