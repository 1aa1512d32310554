"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams (words, pairs of words, first and last letters of words) are scaled by the classes' log-count ratio and
fitted by a linear hinge-loss model with dual coordinate descent. The margin is calibrated on rows that the model has not
seen, so that a score is a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import fold, kept, small_batches, texts, trim
from sextant.llm.labelled import labelled_sample

BITS = 20
MASK = (1 << BITS) - 1
#: Words whose features a worker remembers before it forgets them all: bounds its memory.
CACHE = 200_000


class Ngrams(dict):
    """The set of hashed n-grams of a text: exact words, their first and last three bytes, adjacent pairs, repeats of a word.

    As a dictionary: word -> row of ``table``, which holds the hashes of that word's own n-grams.
    """

    def __init__(self) -> None:
        self.table = np.zeros((CACHE + 1, 3), np.int32)

    def __missing__(self, w: bytes) -> int:
        row = self[w] = len(self)
        self.table[row] = zlib.crc32(w) & MASK, zlib.crc32(w[:3], 7) & MASK, zlib.crc32(w[-3:], 11) & MASK
        return row

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        n = len(words)
        length = zlib.crc32(b"length %d" % n.bit_length()) & MASK
        if not n:
            return np.array([length], np.int32)
        if len(self) + n > CACHE:
            self.clear()
            if n > CACHE:
                self.table = np.zeros((n + 1, 3), np.int32)
        rows = np.fromiter(map(self.__getitem__, words), np.int32, n)
        first = self.table[rows, 0]
        pairs = (first[:-1] * np.int32(40503) ^ first[1:] * np.int32(30011)) & np.int32(MASK)
        same = int(np.count_nonzero(first[:-1] == first[1:]))
        more = [length, zlib.crc32(b"repeats %d" % (same * 8 // n)) & MASK] if same else [length]
        return np.unique(np.concatenate([np.array(more, np.int32), pairs, self.table[np.unique(rows)].ravel()]))


@dataclass
class QualityModel:
    ratio: np.ndarray  # float32, log-count ratio of each n-gram
    weight: np.ndarray  # float32, ratio times the support-vector weight
    bias: float
    slope: float  # of the calibration
    offset: float

    def margin(self, x: np.ndarray) -> float:
        r = self.ratio[x]
        return float(self.weight[x].sum() / (np.sqrt(float((r * r).sum())) + 1e-9)) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -35, 35))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for x, c in zip(rows, y, strict=True):
        (p if c else q)[x] += 1
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 25, seed: int = 0) -> tuple[np.ndarray, float]:
    """Hinge loss, L2 penalty: one dual variable in [0, cost] per row, minimised in a random order each epoch.

    A row's values are its n-grams' ratios, scaled to length 1; they are looked up at each step, so only indicators are held.
    The bias is one more feature of value 1. Rows that stand at a bound with a gradient that keeps them there change nothing.
    """
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    scale = np.array([1 / (float(np.sqrt((ratio[x].astype(np.float64) ** 2).sum())) + 1e-9) for x in rows])
    square = np.array([float((ratio[x].astype(np.float64) ** 2).sum()) for x in rows]) * scale**2 + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            values = ratio[rows[i]] * scale[i]
            g = sign[i] * (float(w[rows[i]] @ values) + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), by damped Newton steps; ends are smoothed as usual."""
    pos, neg = float((y > 0).sum()), float((y == 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[float((v * margins * margins).sum()) + 1e-3, float((v * margins).sum())], [0, float(v.sum()) + 1e-3]])
        h[1, 0] = h[0, 1]
        step = np.linalg.solve(h, [float((d * margins).sum()), float(d.sum())])
        step /= max(1.0, float(np.abs(step).max()) / 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def fit(sample: list[tuple[bytes, int]], cost: float = 1.0, blend: float = 0.5, parts: int = 3) -> QualityModel:
    """Fit on a sample; out-of-part margins calibrate. Without both classes, every text gets the share of ones."""
    y = np.array([c for _, c in sample], np.int64)
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        zero = np.zeros(1 << BITS, np.float32)
        return QualityModel(zero, zero, 0.0, 1e-3, float(np.log(share / (1 - share))))
    grams = Ngrams()
    rows = [grams.of(t) for t, _ in sample]
    del grams

    def one(keep: np.ndarray) -> QualityModel:
        ratio = log_count_ratio([rows[i] for i in keep], y[keep])
        share = float(y[keep].mean())
        each = np.where(y[keep] > 0, 0.5 / share, 0.5 / (1 - share)) * cost * 4
        w, bias = dual_coordinate_descent([rows[i] for i in keep], ratio, y[keep], each)
        mean = float(np.abs(w).sum() / max(1, np.count_nonzero(w)))
        w = (1 - blend) * mean + blend * w  # between the plain Bayes weights and the support-vector weights
        return QualityModel(ratio, (w * ratio).astype(np.float32), bias, 1.0, 0.0)

    place = np.random.default_rng(1).integers(0, parts, len(y))
    margins = np.zeros(len(y))
    seen = np.zeros(len(y), bool)
    for k in range(parts):
        keep, out = np.flatnonzero(place != k), np.flatnonzero(place == k)
        if len(keep) and len(out) and y[keep].min() < y[keep].max():
            m = one(keep)
            margins[out] = [m.margin(rows[i]) for i in out]
            seen[out] = True
    model = one(np.arange(len(y)))
    if seen.any() and y[seen].min() < y[seen].max():
        model.slope, model.offset = platt(margins[seen], y[seen])
    return model


def _scorer(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grams = model.value, kept("quality", Ngrams)
        for b in batches:
            got = [own.score(grams.of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``: its whole text, null as empty; rows are neither merged nor dropped."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # 2 x 4 MB, whatever the corpus
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(_scorer(held), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, bound: int = 6000) -> QualityModel:
    """Learn from at most ``bound`` labelled rows outside the fold crc32(doc_id) mod ``mod`` = ``held``. The driver keeps only the model."""
    model = fit(labelled_sample(docs, labels, "quality", mod, held, bound))
    trim()
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null texts are empty texts and scored; a null doc_id is scored with held_out null; repeated rows each give a row; an empty
    table gives no rows; other columns are ignored, whatever their names. Without labels of both classes the score is the
    (smoothed) share of ones.
    """
    return with_outcome(score(docs, train(docs, labels)), 4, 2, threshold)


def with_outcome(scored: DataFrame, mod: int, held: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, corpus: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (its own columns) that score ``threshold`` or more under a model learned from ``corpus`` and ``labels``.

    Scoring is a column, so rows keep their place. Null texts are scored as empty ones; rows without a doc_id and repeated rows are kept
    or not by their text; very long texts are scored whole; an empty table gives no rows; other columns stay as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(train(corpus, labels))

    @F.pandas_udf("double")
    def judged(t):
        import pandas as pd

        grams = kept("quality", Ngrams)
        return pd.Series([held.value.score(grams.of(x or b"")) for x in t], dtype="float64")

    return docs.where(judged(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")) >= threshold)
