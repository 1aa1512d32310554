"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (and of itself); a bag is the mean of its words; a linear
softmax reads that mean. The bags of a text are its windows of WINDOW words, every word in one at least, and a text is as toxic as its
worst bag: an insult among hundreds of words would be averaged away in one bag of the whole text. Training starts from whole texts
(cut at random where they are long, as no window stands out yet) and then passes the gradient through the worst window. Unseen misspellings share n-grams with seen words. What stands
between blanks and is longer than LONG bytes (CJK, minified text) counts as overlapping pieces, each a word of the windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import small_batches, texts
from sextant.llm.labelled import labelled_sample
from sextant.llm.quality import platt, with_outcome
from sextant.llm.shingles import chunks

BITS = 18
BUCKETS = 1 << BITS
DIM = 12
WINDOW, STRIDE = 12, 4
#: Words that are hashed at once in training.
SLICE = 20_000
#: Words that a worker remembers before it forgets them all: bounds its memory.
CACHE = 400_000
#: Bytes of the longest word that counts as one; of a piece of a longer one, and from piece to piece.
LONG, PIECE, STEP = 96, 16, 8
STRIP = b".,;:!?\"'()[]|*#$%&"


def words_of(text: bytes) -> list[bytes]:
    """Words at ASCII white space. One over LONG bytes gives pieces that hold all of its n-grams, the last flush with its end."""
    words = text.split()
    if len(text) <= LONG or max(map(len, words), default=0) <= LONG:
        return words
    out = []
    for w in words:
        bare = w if len(w) <= LONG else w.strip(STRIP)
        bare = bare or w  # nothing but punctuation
        if len(bare) <= LONG:
            out.append(bare)
        else:
            out += [bare[k : k + PIECE] for k in (*range(0, len(bare) - PIECE, STEP), len(bare) - PIECE)]
    return out


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words in a row, and how many each word has: itself and its 3- to 6-byte n-grams between end marks.

    ASCII case and punctuation at the edges don't count. All words are hashed at once, as one buffer.
    """
    bare = [b"^%b$" % (w.lower().strip(STRIP) or w) for w in words]
    size = np.fromiter(map(len, bare), np.int64, len(bare))
    raw = np.frombuffer(b"".join(bare) + b"\0" * 6, np.uint8).astype(np.uint32)
    total = len(raw) - 6
    left = np.repeat(np.cumsum(size), size) - np.arange(total)  # bytes up to the word's end
    of = np.repeat(np.arange(len(bare)), size)
    whole = np.fromiter(map(zlib.crc32, bare), np.uint32, len(bare)) >> np.uint32(32 - BITS)
    buckets, owners = [whole], [np.arange(len(bare))]
    rolled = raw[:total] * np.uint32(0x01000193)
    for n in range(2, 7):
        rolled = (rolled ^ raw[n - 1 : n - 1 + total]) * np.uint32(0x01000193)
        if n > 2:
            keep = left >= n
            mixed = (rolled[keep] ^ (rolled[keep] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            buckets.append(mixed >> np.uint32(32 - BITS))
            owners.append(of[keep])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int32), np.bincount(owner, minlength=len(bare)).astype(np.int32)


def indexed(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text as numbers of its distinct words, and those words' buckets in a row with how many each has.

    Words are hashed SLICE at a time and dropped, so what is held is four bytes a word of a text and four an n-gram of a distinct word.
    """
    ids: dict[bytes, int] = {}
    docs = [once(np.fromiter((ids.setdefault(w, len(ids)) for w in words_of(t)), np.int32)) for t in texts]
    words = list(ids)
    del ids
    parts = []
    while words:
        parts.append(subwords(words[-SLICE:]))
        del words[-SLICE:]
    parts.reverse()
    return docs, np.concatenate([b for b, _ in parts] or [np.zeros(0, np.int32)]), np.concatenate([n for _, n in parts] or [np.zeros(0, np.int32)])


@dataclass
class ToxicityModel:
    vectors: np.ndarray  # (BUCKETS, DIM) float32
    softmax: np.ndarray  # (2, DIM)
    bias: np.ndarray  # (2,)
    slope: float = 1.0
    offset: float = 0.0

    def logits(self) -> np.ndarray:
        """Of each bucket: what its vector adds to the log odds of class 1. The model is linear, so means of these are enough."""
        return (self.vectors @ (self.softmax[1] - self.softmax[0])).astype(np.float32)


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STRIDE, the last one flush with the end."""
    return np.unique(np.append(np.arange(0, max(1, n - WINDOW + 1), STRIDE), max(0, n - WINDOW)))


def once(words: np.ndarray) -> np.ndarray:
    """Words (or their values) of which repeats in a row count once, so that a repeated word fills no window."""
    return words[np.concatenate([[True], words[1:] != words[:-1]])] if len(words) else words


def worst(values: np.ndarray) -> tuple[float, int]:
    """Largest window mean of a text's word values, and where that window starts."""
    n = len(values)
    if not n:
        return 0.0, 0
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    at = window_starts(n)
    means = (total[np.minimum(at + WINDOW, n)] - total[at]) / np.minimum(WINDOW, n)
    k = int(means.argmax())
    return float(means[k]), int(at[k])


def fit(sample: list[tuple[bytes, int]], epochs: int = 14, rate: float = 0.4, seed: int = 0) -> ToxicityModel:
    """Joint Adagrad on vectors and softmax; every fifth text is kept out of it and calibrates the score."""
    rng = np.random.default_rng(seed)
    model = ToxicityModel(((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32), np.zeros((2, DIM)), np.zeros(2))
    y = np.array([c for _, c in sample], np.int64)
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        model.slope, model.offset = 1e-3, float(np.log(share / (1 - share)))
        return model
    model.softmax[:] = rng.normal(0, 0.3, (2, DIM))
    docs, flat, sizes = indexed([t for t, _ in sample])
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    apart = np.arange(len(y)) % 5 == 4
    if not (y[apart].any() and (y[apart] == 0).any() and y[~apart].any() and (y[~apart] == 0).any()):
        apart[:] = False
    learn = np.flatnonzero(~apart & np.array([len(d) > 0 for d in docs]))
    seen_v, seen_w = np.full(BUCKETS, 1e-6), np.full((2, DIM), 1e-6)
    weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))

    def word_values() -> np.ndarray:
        return np.add.reduceat(model.logits()[flat], begin) / sizes

    for epoch in range(epochs):  # about forty steps an epoch at least, so that a small sample is learned too
        values = word_values()
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // min(128, max(8, len(learn) // 40)))):
            bags, labels, cost = [], [], []
            for i in part:
                d = docs[i]
                if epoch < 3:  # the whole text first, as no window stands out yet
                    picks = [d if len(d) <= 200 else d[(k := rng.integers(0, len(d) - 199)) : k + 200]]
                else:
                    at = worst(values[d])[1]
                    picks = [d[at : at + WINDOW]]
                    if not y[i]:
                        k = rng.integers(0, max(1, len(d) - WINDOW))
                        picks.append(d[k : k + WINDOW])
                for words in picks:
                    bags.append(words)
                    labels.append(y[i])
                    cost.append(weight[i] / len(picks))
            count = np.array([len(x) for x in bags], np.int64)
            words = np.concatenate(bags)
            reps = sizes[words]
            idx = flat[np.repeat(begin[words] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(int(reps.sum()))]
            share = np.repeat(1.0 / (reps * np.repeat(count, count)), reps)
            bag = np.repeat(np.repeat(np.arange(len(bags)), count), reps)
            hot, inv = np.unique(idx, return_inverse=True)
            # The mean vector of every bag, one dimension at a time.
            mean = np.stack([np.bincount(bag, share * model.vectors[idx, k], len(bags)) for k in range(DIM)], 1)
            z = mean @ model.softmax.T + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(bags)), labels] -= 1
            p *= np.array(cost)[:, None]
            back = p @ model.softmax
            grad = np.stack([np.bincount(inv, share * back[bag, k], len(hot)) for k in range(DIM)], 1)
            seen_v[hot] += (grad * grad).mean(1)
            model.vectors[hot] -= (rate * grad / np.sqrt(seen_v[hot])[:, None] * 0.2).astype(np.float32)
            g = p.T @ mean + 1e-4 * model.softmax
            seen_w += g * g
            model.softmax -= rate * g / np.sqrt(seen_w)
            model.bias -= 0.01 * p.mean(0)
    values = word_values()
    margins = np.array([worst(values[d])[0] for d in docs])
    use = apart if apart.any() else np.ones(len(y), bool)
    model.slope, model.offset = platt(margins[use], y[use])
    return model


class Scorer(dict):
    """word -> its value under a model."""

    def __init__(self, model: ToxicityModel) -> None:
        self.logits, self.slope, self.offset = model.logits(), model.slope, model.offset

    def learn(self, words: set[bytes]) -> None:
        if len(self) > CACHE:
            self.clear()
        if new := [w for w in words if w not in self]:
            flat, sizes = subwords(new)
            self.update(zip(new, (np.add.reduceat(self.logits[flat], np.cumsum(sizes) - sizes) / sizes).tolist(), strict=True))

    def score(self, text: bytes) -> float:
        return next(self.scores([text]))

    def _score(self, words: list[bytes]) -> float:
        m, _ = worst(once(np.fromiter(map(self.__getitem__, words), np.float64, len(words))))
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -35, 35))))

    def scores(self, texts: list[bytes]) -> Iterator[float]:
        for i, j in chunks([len(t) for t in texts], 1 << 18):
            split = [words_of(t) for t in texts[i:j]]
            self.learn({w for words in split for w in words})
            yield from map(self._score, split)


def _scorer(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in batches:
            got = list(scorer.scores(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``: its whole text, null as empty; rows are neither merged nor dropped."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # BUCKETS x DIM floats, whatever the corpus
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(_scorer(held), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, bound: int = 5000) -> ToxicityModel:
    """Learn from at most ``bound`` labelled rows outside the fold crc32(doc_id) mod ``mod`` = ``held``."""
    return fit(labelled_sample(docs, labels, "toxic", mod, held, bound))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null texts are empty texts and scored (by the bias); a null doc_id is scored with held_out null; repeated rows each give a
    row; an empty table gives no rows; other columns are ignored. Without labels of both classes the score is the share of ones.
    """
    return with_outcome(score(docs, train(docs, labels)), 5, 0, threshold)
