"""Quality classifier by positive-unlabelled learning.

Only trusted good texts and unlabelled web text are used.  The non-negative unbiased risk
``prior * R_p+ + max(0, R_u- - prior * R_p-)`` is taken with the squared loss, for which
all that it needs of the unlabelled texts are their mean and second moments: these are
summed over every row of the learning fold in one pass, so no unlabelled row is left out
at any size.  The share of good text in the web (the class prior) is read off how a first
classifier, fitted on one half of the rows, scores all rows of the other.  The threshold is
where the same risk, with the zero-one loss and over all rows, is least.
Features are computed on whole texts in Arrow batches: shares of hashed word and
character n-grams and a few shape statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.llm._common import held_out, id_and_text, slices, tidy
from codeframe.llm._words import Hasher, Words, base_counts, hashed_counts
from codeframe.llm.quality_rules import features, sample_rows, sigmoid

WORD_BINS, CHAR_BINS = 256, 512
#: Shares of n-grams are of at least so many, so that a few words alone decide nothing.
GRAM_FLOOR = 200
#: n-gram shares are scaled by this and not by their spread: rare grams stay small.
GRAM_SPREAD = 0.1
#: Bound of the sample of labelled rows, chosen by a hash of the id.
POSITIVE_ROWS = 4_000
#: A score is the logistic of so many times the classifier's value, which is -1 for bad and 1 for good.
SLOPE = 4.0


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x - self.mean) / self.spread @ self.weights + self.bias)


def kernel(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row per text: shape statistics, then hashed n-grams; zeros for the empty text."""
    w = Words(data, offs)
    hasher = Hasher(data)
    h = hasher(w.start, w.end)
    c = base_counts(w, hasher, h)
    n = np.maximum(c["n_words"], 1)
    size = np.maximum(np.diff(offs), 1)
    alone = w.end - w.start == 1
    mark = np.zeros(len(h), bool)
    punct = np.zeros(256, bool)
    punct[[x for x in range(33, 127) if not chr(x).isalnum()]] = True
    mark[alone] = punct[data[w.start[alone]]] if len(h) else mark[alone]
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    count = lambda flags: np.bincount(w.doc, weights=flags, minlength=w.n_docs)
    _, one = np.unique(h + w.doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), return_index=True)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    shape = np.stack(
        [
            np.minimum(c["n_symbols"] / n, 2), count(mark) / n, count(same) / n, c["n_repeat_words"] / n, np.minimum(c["n_dup_lines"] / n * 10, 2),
            w.per_text(upper) / np.maximum(w.per_text(upper | lower), 1), w.per_text((data >= 48) & (data <= 57)) / size,
            np.minimum(w.per_text(punct[data]) / n, 3), w.per_text(data == 33) / n, np.bincount(w.doc[one], minlength=w.n_docs) / np.sqrt(n) / 10,
            np.minimum(c["word_chars"] / n, 20) / 10, np.log1p(c["n_words"]) / 10,
        ],
        1,
    ).astype(np.float32)
    return np.concatenate([shape, hashed_counts(w, h, WORD_BINS, CHAR_BINS, GRAM_FLOOR)], 1)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x x' (x: features and a one) over rows of (half, text), for each half.

    Tasks add up their rows; sums of tasks are added in partitions of matrix rows, so that
    the driver gets one matrix a half, however many rows and tasks there are.
    """
    width = len(kernel(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0]) + 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            half = b.column(0).to_numpy()
            for i, j, data, offs in slices(b.column(1)):
                x = _with_one(kernel(data, offs))
                for h in np.unique(half[i:j]).tolist():
                    own = x[half[i:j] == h]
                    total[h] = total.get(h, 0) + (own.T @ own).astype(np.float64)
        for h, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([h] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([m[i, i:].astype(np.float32).tobytes() for i in range(width)], pa.binary())], ["half", "i", "row"])

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for h, i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                total[h, i] = total.get((h, i), 0) + np.frombuffer(raw.as_py(), np.float32).astype(np.float64)
        for (h, i), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["half", "i", "row"])

    schema = "half int, i int, row binary"
    out = np.zeros((2, width, width))
    for r in rows.mapInArrow(run, schema).repartition("half", "i").mapInArrow(add, schema).collect():
        out[r.half, r.i, r.i :] = out[r.half, r.i :, r.i] = np.frombuffer(r.row, np.float64)
    return out[0], out[1]


def counts_above(rows: DataFrame, value, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of each half reach each cut, and how many there are; counted in tasks.

    ``value`` gives a row of m values per text, ``cuts`` has a row of ascending cuts for each of them.
    """
    m, k = cuts.shape

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, m * k + 1), np.int64)
        for b in batches:
            half = b.column(0).to_numpy()
            for i, j, data, offs in slices(b.column(1)):
                v = value(kernel(data, offs))
                for h in (0, 1):
                    own = np.sort(v[half[i:j] == h], axis=0)
                    out[h, :-1] += np.concatenate([len(own) - np.searchsorted(own[:, x], cuts[x]) for x in range(m)])
                    out[h, -1] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel(), pa.int64())], ["cut", "n"])

    got = np.zeros(2 * (m * k + 1), np.int64)
    for r in rows.mapInArrow(run, "cut int, n long").groupBy("cut").agg(F.sum("n").alias("n")).collect():
        got[r.cut] = r.n
    got = got.reshape(2, -1)
    return got[:, :-1].reshape(2, m, k), got[:, -1]


#: Shares of positives that thresholds for the prior keep.
KEEP = np.linspace(1.0, 0.1, 91)


def estimate_prior(positive: np.ndarray, above: np.ndarray, n: int, slack: float = 0.03) -> float:
    """The least ratio of unlabelled to positive mass above a threshold, over thresholds that keep enough positives.

    ``above``: shares of the ``n`` unlabelled scores at or over the quantiles of ``positive`` at ``1 - KEEP``.
    """
    best = 1.0
    for t, u in zip(np.quantile(positive, 1 - KEEP), above):
        p = (positive >= t).mean()
        best = min(best, (u + slack / np.sqrt(p) * np.sqrt(u * (1 - u) / max(n, 1)) * 30) / p)
    return float(np.clip(best, 0.02, 0.98))


def risk(w: np.ndarray, second: np.ndarray, pos: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * R_p+, R_u- - prior * R_p-, and their gradients; second: mean of x x' of unlabelled rows, whose last feature is one."""
    z, one = pos @ w, np.eye(len(w))[-1]
    a = w + one
    good, bad = prior * np.square(1 - z).mean() / 4, a @ second @ a / 4 - prior * np.square(1 + z).mean() / 4
    return good, bad, -prior * ((1 - z) @ pos) / len(pos) / 2, second @ a / 2 - prior * ((1 + z) @ pos) / len(pos) / 2


def minimise(second: np.ndarray, pos: np.ndarray, prior: float, l2: float) -> np.ndarray:
    """The w of least non-negative risk.

    Where the second part of the risk is not negative at the least sum of both, that is the
    answer; else the least first part at which the second is zero, found by bisecting the
    weight ``t`` of the second part.
    """
    ridge = l2 * np.diag(np.append(np.ones(len(second) - 1), 0.0)) + 1e-9 * np.eye(len(second))
    mean, own = pos.mean(0), pos.T @ pos / len(pos)
    at = lambda t: np.linalg.solve(prior * (1 - t) * own + t * second + ridge, prior * (1 + t) * mean - t * second[-1])
    lo, hi, w = 0.0, 1.0, at(1.0)
    if risk(w, second, pos, prior)[1] >= 0:
        return w
    for _ in range(40):
        t = (lo + hi) / 2
        w = at(t)
        lo, hi = (t, hi) if risk(w, second, pos, prior)[1] >= 0 else (lo, t)
    return w


#: Priors for which the classifier is prepared, and values at which its threshold may lie.
PRIORS, VALUES = np.linspace(0.05, 0.95, 19), np.linspace(-3, 3, 121)


def threshold(pos: np.ndarray, above: np.ndarray, prior: float) -> float:
    """The middle of the values at which the non-negative risk of the zero-one loss is least, up to half a percent."""
    keep = (pos[None, :] >= VALUES[:, None]).mean(1)
    lost = prior * (1 - keep) + np.maximum(0, above - prior * keep)
    best = VALUES[lost <= lost.min() + 0.005]
    return float((best[0] + best[-1]) / 2)


def fit(pos: np.ndarray, halves: tuple[np.ndarray, np.ndarray], above, l2: float = 0.1) -> Model:
    """The model from positives and the moments of both halves of the unlabelled rows; constant 1 when either is missing.

    ``above(value, cuts)`` counts the unlabelled rows of each half whose values reach each cut.
    """
    width, n = pos.shape[1], halves[0][-1, -1] + halves[1][-1, -1]
    if not len(pos) or n < 1:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 4.0, 1.0)
    both = (halves[0] + halves[1]) / n
    mean = both[-1, :-1]
    spread = np.maximum(np.sqrt(np.maximum(np.diag(both)[:-1] - mean * mean, 0)), 1e-2)
    spread[-(WORD_BINS + CHAR_BINS) :] = GRAM_SPREAD
    # moments of scaled features from those of raw ones
    scale = np.diag(np.append(1 / spread, 1.0))
    scale[-1, :-1] = -mean / spread
    scaled = lambda m: scale.T @ (m / max(m[-1, -1], 1)) @ scale
    p, odd = _with_one((pos - mean) / spread), np.arange(len(pos)) % 2 == 1
    known = bool(odd.any() and halves[0][-1, -1] and halves[1][-1, -1])
    # the prior is read off rows that the first classifier was not fitted on
    half, some = scaled(halves[0] if known else halves[0] + halves[1]), p[~odd] if known else p
    first = np.linalg.solve(some.T @ some / len(some) + half + np.eye(width + 1), some.mean(0) - half[-1])
    second = scaled(halves[0] + halves[1])
    w = np.stack([first, *(minimise(second, p, prior, l2) for prior in PRIORS)], 1)
    raw, shift = w[:-1] / spread[:, None], w[-1] - mean / spread @ w[:-1]
    seen = p @ w
    cuts = np.vstack([np.pad(np.quantile(seen[odd if known else ~odd, 0], 1 - KEEP), (0, len(VALUES) - len(KEEP)), "edge"), *[VALUES] * len(PRIORS)])
    count, size = above(lambda x: x @ raw + shift, cuts)
    prior = estimate_prior(seen[odd, 0], count[1, 0, : len(KEEP)] / size[1], int(size[1])) if known else 0.5
    at = 1 + int(np.abs(PRIORS - prior).argmin())
    t = threshold(seen[:, at], count[:, at].sum(0) / size.sum(), prior)
    return Model(mean, spread, SLOPE * w[:-1, at], float(SLOPE * (w[-1, at] - t)), prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE_ROWS) -> Model:
    """Fit on the learning fold only: rows whose ``held_out`` is false, all of them as unlabelled text."""
    docs = docs.where(~held_out())
    good = sample_rows(docs, labels.where((F.col("quality") == 1) & ~held_out()), positives)
    rows = id_and_text(docs).select(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)).cast("int").alias("half"), "text")
    return fit(features(good, kernel)[0].astype(np.float64), moments(rows), lambda value, cuts: counts_above(rows, value, cuts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and predicted (1 if score >= 0.5) of every whole text.

    Null text is scored as the empty text; null ids stay null and count as held out;
    repeated rows are scored each; other columns are ignored.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(1)):
                s = model.score(kernel(data, offs))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, all columns as they were; nothing is shuffled.

    Null text is judged as the empty text; repeated rows are judged each.
    """
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(at)):
                yield b.slice(i, j - i).filter(pa.array(model.score(kernel(data, offs)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
