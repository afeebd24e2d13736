"""Quality rules: exact base counts, and a hashed n-gram logistic regression against fixed thresholds.

The regression sees shares of hashed word 1- and 2-grams and of hashed character
3-grams.  It is trained on labelled rows, its output is calibrated to a
probability on rows that the weights never saw, and Arrow batches of whole texts
are scored against a threshold that is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.llm._common import id_and_text, slices, tidy
from codeframe.llm._words import Hasher, Words, base_counts, hashed_counts

#: Bins of word n-grams and of character n-grams (a power of two).
WORD_BINS, CHAR_BINS = 4096, 2048
#: At most so many labelled rows fit the model, the smallest by a hash of their id.
TRAIN_ROWS = 4_000
#: A text passes with at least this calibrated probability of being good.
KEEP_AT = 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float  # calibrated: p = sigmoid(scale * logit + shift)
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * (x @ self.weights + self.bias) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))


def adam(grad, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam; ``grad(w)`` is the full gradient, so the fit is deterministic."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> Model:
    """Logistic regression on four fifths of the rows; Platt scaling on the others.

    With one class only, or no row, the model is constant: the share of good rows
    (smoothed), or 1 without rows, so that nothing is rejected for want of labels.
    """
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 1.0) if len(y) == 0 or y.max() == 1 else 1 / (len(y) + 2.0)
        return Model(np.zeros(x.shape[1]), 0.0, 1.0, float(np.log(p / (1 - p))) if p < 1 else 30.0)
    hold = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or len(set(y[hold])) < 2:
        hold[:] = False
    xa, ya = x[~hold] if hold.any() else x, y[~hold]

    def grad(w):
        r = (sigmoid(xa @ w[:-1].astype(np.float32) + w[-1]) - ya) / len(ya)
        return np.append(r.astype(np.float32) @ xa + l2 * w[:-1], r.sum())

    w = adam(grad, np.zeros(x.shape[1] + 1), 400, 0.1)
    scale, shift = 1.0, 0.0
    if hold.any():
        z, t = x[hold] @ w[:-1].astype(np.float32) + w[-1], y[hold]
        t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's targets

        def calibrate(p):
            r = (sigmoid(p[0] * z + p[1]) - t) / len(t)
            return np.array([r @ z + 1e-3 * (p[0] - 1), r.sum()])

        scale, shift = adam(calibrate, np.array([1.0, 0.0]), 300, 0.05)
    return Model(w[:-1], float(w[-1]), float(max(scale, 0.05)), float(shift))


def sample_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts of at most ``rows`` labelled ids: (doc_id, text, y).

    Ids come in the order of a hash, so the choice does not depend on partitions.  An
    id with both labels, or none, teaches nothing; a repeated id counts once, with its
    smallest text.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("z"))
        .where("y = z")
        .select("doc_id", "y")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most ``rows`` rows of two numbers: a proven bound
    return id_and_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def features(rows: DataFrame, kernel) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a bounded sample, on the driver, in the order of ids.

    ``kernel(data, offs)`` gives a float32 row per text; executors run it.  Rows are mostly
    zeros and travel compressed.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for i, j, data, offs in slices(b.column(1)):
                raw = pa.array([pack(r.tobytes()) for r in kernel(data, offs)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), raw, b.column(2).slice(i, j - i)], ["doc_id", "x", "y"])

    got = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x binary, y int").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.float64)
    x = np.zeros((len(y), len(kernel(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])), np.float32)
    unpack = zstandard.ZstdDecompressor().decompress
    for i, raw in enumerate(got["x"]):
        x[i] = np.frombuffer(unpack(raw.as_py()), np.float32)
    return x, y


def ngram_row(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    w = Words(data, offs)
    return hashed_counts(w, Hasher(data)(w.start, w.end), WORD_BINS, CHAR_BINS)


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    """Expected calibration error: mean gap of probability and share of good rows, over bins of probability."""
    at = np.minimum((p * bins).astype(int), bins - 1)
    n = np.maximum(np.bincount(at, minlength=bins), 1)
    gap = np.abs(np.bincount(at, p, bins) / n - np.bincount(at, y, bins) / n)
    return float((gap * np.bincount(at, minlength=bins)).sum() / max(len(p), 1))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return fit(*features(sample_rows(docs, labels, rows), ngram_row))


def apply_rules(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, base verdict, probability and verdict of every whole text.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, probability.  Null text counts as no words, so it fails the base
    rules; null ids stay null, repeated rows are judged each, other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(1)):
                w = Words(data, offs)
                hasher = Hasher(data)
                h = hasher(w.start, w.end)
                c = base_counts(w, hasher, h)
                p = model.probability(hashed_counts(w, h, WORD_BINS, CHAR_BINS))
                failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(c[k], pa.int64()) for k in names), pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p, pa.float64())],
                    ["doc_id", *names, "base_failed", "kept", "probability"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
