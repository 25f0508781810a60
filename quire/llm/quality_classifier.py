"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_j w_j x_j + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2)): all pairwise interactions
of a document's features, of low rank, in time linear in its features.  Features are the words of the whole text,
hashed to ``2 ** bits`` counts of a row of length one, statistics of the text's structure, and the ``n_chars`` column.
Weights are trained by Adagrad on a bounded sample of labelled rows (``most``) that aren't held out.

Defined results: null and empty text have no words and are scored from their statistics; a null ``n_chars`` counts
as the text's own length; rows without a label are scored but not learned from, a label other than 0 or 1 is none;
several labels of one doc_id are each learned from; with no row to learn from every score is 0.5; repeated rows get
equal results; columns other than doc_id, text and n_chars (and the labels' doc_id and quality) are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held_out, table
from quire.llm.sampling import bounded_sample

BITS, RANK = 16, 8
#: Labelled rows of the training sample, at most.
MOST = 8000
#: Classes of bytes whose shares are features: upper case, lower case, digits, spaces, line ends, beyond ASCII, sentence marks, other marks.
_CLASSES = np.full(256, 7)
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58], _CLASSES[32], _CLASSES[10], _CLASSES[128:] = 0, 1, 2, 3, 4, 5
_CLASSES[[ord(c) for c in ".,;:?"]] = 6
N_STATS = 24


class HashedWords(dict):
    """word -> feature; forgotten when it has grown large."""

    def __init__(self, bits: int) -> None:
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = zlib.crc32(word) & self.mask
        return value


def document_features(text: bytes, n_chars: int | None, words_of: HashedWords) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(hashed words, their values of a row of length one, structure statistics and metadata)."""
    words = Counter(text.split())
    n = max(words.total(), 1)
    at, nth = np.unique(np.fromiter(map(words_of.__getitem__, words), np.int64, len(words)), return_inverse=True)
    values = np.log1p(np.bincount(nth, np.fromiter(words.values(), np.float64, len(words)), len(at)))
    values /= max(float(np.sqrt(values @ values)), 1e-12)
    per_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASSES, per_byte, 8) / max(len(text), 1)
    lines = text.split(b"\n")
    again = Counter(lines)
    lengths = np.array([len(x) for x in lines])
    chars = len(text) - int(per_byte[128:192].sum())
    stats = [
        *kinds, np.log1p(n), np.log1p(len(text)), len(text) / n / 10, len(words) / n, max(words.values(), default=0) / n,
        np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()), 1 - len(again) / len(lines), max(again.values()) / len(lines),
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), text.count(b"|") / n, text.count(b"!") / n, sum(text.count(c) for c in (b"#", b"$", b"%", b"&", b"*")) / n,
        np.log1p(chars if n_chars is None else max(n_chars, 0)), np.log1p(chars) - np.log1p(chars if n_chars is None else max(n_chars, 0)),
    ]
    return at, values, stats


@dataclass
class FactorisationMachine:
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, list[float]]], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, their values, where each row begins): hashed words, then the statistics, so no row is empty."""
        stats = np.clip((np.array([s for _, _, s in found]) - self.mean) / self.scale, -4, 4).astype(np.float32)
        last = np.arange(1 << bits, (1 << bits) + N_STATS)
        at = np.concatenate([x for words, _, _ in found for x in (words, last)])
        values = np.concatenate([x for (_, v, _), s in zip(found, stats, strict=True) for x in (v, s)]).astype(np.float32)
        lengths = np.array([len(words) + N_STATS for words, _, _ in found])
        return at, values, np.cumsum(lengths) - lengths

    def sums(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Per row and factor the sum of v x."""
        return np.add.reduceat(self.v[at] * x[:, None], starts)

    def logits(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The sum-of-squares identity: linear in a row's own features and the rank."""
        squares = np.add.reduceat((self.v[at] * x[:, None]) ** 2, starts)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (self.sums(at, x, starts) ** 2 - squares).sum(axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(found: list[tuple[np.ndarray, np.ndarray, list[float]]], y: np.ndarray, bits: int = BITS, rank: int = RANK, epochs: int = 10, batch: int = 64, rate: float = 0.1, l2: float = 1e-4) -> FactorisationMachine:
    stats = np.array([s for _, _, s in found])
    random = np.random.default_rng(11)
    width = (1 << bits) + N_STATS
    m = FactorisationMachine(stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6), 0.0, np.zeros(width, np.float32), random.normal(0, 0.01, (width, rank)).astype(np.float32))
    gw, gv, g0 = np.full(width, 1e-6, np.float32), np.full((width, rank), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(found)), max(len(found) // batch, 1)):
            at, x, starts = m.rows([found[i] for i in part], bits)
            e = ((_sigmoid(m.logits(at, x, starts)) - y[part]) / len(part)).astype(np.float32)
            each = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(at))))
            used, nth = np.unique(at, return_inverse=True)  # only these have a gradient
            total = lambda values: np.bincount(nth, values, len(used)).astype(np.float32)
            pull = e[each] * x
            dw = total(pull) + l2 * m.w[used]
            inner = m.sums(at, x, starts)[each]
            squared = total(pull * x)
            dv = np.stack([total(pull * inner[:, f]) for f in range(rank)], axis=1) - m.v[used] * squared[:, None] + l2 * m.v[used]
            d0 = float(e.sum())
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += d0 * d0
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
            m.w0 -= rate * d0 / g0**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, bits: int = BITS) -> FactorisationMachine | None:
    """Learns ``labels`` (doc_id, quality) of the rows of ``docs`` (doc_id, text, n_chars) that aren't held out."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out())
    chosen = bounded_sample(marks, "doc_id", most)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = HashedWords(bits)
        for batch in batches:
            found = [document_features(text or b"", n, words_of) for text, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([at.astype("<u4").tobytes() for at, _, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x, _ in found], pa.binary()), pa.array([s for _, _, s in found], pa.list_(pa.float64()))],
                ["doc_id", "quality", "at", "x", "stats"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    sample = rows.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string"), "quality", "text", "n_chars").mapInArrow(featurise, "doc_id string, quality int, at binary, x binary, stats array<double>")
    # Documents that share a chosen doc_id may be many: of all rows those of the smallest hashes, and as many as ids.
    sample = sample.orderBy(F.xxhash64("doc_id", "quality", "at", "x")).limit(most).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["doc_id"] or "", r["quality"], r["at"]))
    found = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["x"], "<f4"), r["stats"]) for r in sample]
    return fit(found, np.array([r["quality"] for r in sample], np.float32), bits)


def score(docs: DataFrame, model: FactorisationMachine | None, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, n_chars): doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the features and rank alone

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, m = HashedWords(bits), shared.value
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [document_features(text or b"", n, words_of) for text, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                scores.append(_sigmoid(m.logits(*m.rows(found, bits))).astype(np.float64) if m else np.full(len(found), 0.5))
            p = np.concatenate([*scores, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
