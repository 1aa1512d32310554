"""Benchmark decontamination: an inverted index of test items, queried by every passage with block-max WAND.

Test items are cut into segments of at most SEGMENT words (the last one flush with the end, so every word is in one) and indexed by BM25
impact, scaled so that a segment scores 1 against itself; every posting list is in blocks that know their largest impact. A large test
set is searched shard by shard, with the statistics of the whole set. Each text is cut into overlapping passages that hold any
segment whole, and every passage is a query that retrieves all segments scoring THRESHOLD or more (no top k). A retrieved item
is verified: enough of the word n-grams of its first half (the question) and of its second (the answer) must stand in the text. n is 5,
or less for short halves, so that one changed word never fails one; grams under 5 words must stand in the very passage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import kept, small_batches, texts
from sextant.llm.shingles import chunks, mix, word_hashes

K1, B = 1.2, 0.75
SEGMENT, STRIDE = 48, 48
PASSAGE = SEGMENT + STRIDE
THRESHOLD = 0.5
#: Least share of the 5-grams of question and of answer.
OVERLAP = 0.5
NGRAM = 5
BLOCK = 16
#: What the most frequent terms of a segment may add up to and still be left out of the first bound.
SPARE = 0.25
#: Items of one broadcast index; a larger test set is searched in several passes over the documents.
SHARD = 20_000


def gram_length(words: int) -> int:
    """Of a half of so many words: one changed word spoils n of its words - n + 1 grams, which shall be half of them at most."""
    return max(1, min(NGRAM, (words + 1) // 3))


def ngrams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    out = np.full(max(0, len(hashed) - n + 1), n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + len(out)]
    return mix(out)


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    begin: np.ndarray  # of each term's postings, with the end
    segment: np.ndarray  # of each posting, ascending in a term
    impact: np.ndarray
    block: np.ndarray  # largest impact of the posting's block of BLOCK postings
    most: np.ndarray  # largest impact of each term
    item: np.ndarray  # of each segment: the item's place in ``ids``
    ids: list[int]
    halves: list[list[tuple[int, np.ndarray]]]  # of each item: (n, distinct n-grams) of question and answer
    telling: tuple[np.ndarray, np.ndarray, np.ndarray]  # postings without each segment's most frequent terms: begin, segment, impact
    need: np.ndarray  # of each segment: what a passage must have in ``telling`` to reach THRESHOLD

    def search(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(segment, score) of all segments that distinct ``terms`` (places in ``terms``) give ``threshold`` or more: block-max WAND."""
        seg, imp, block = self.segment, self.impact, self.block
        cursors = [[int(self.begin[t]), int(self.begin[t + 1]), float(self.most[t])] for t in terms.tolist()]
        found = []
        slack = threshold - 1e-9
        while True:
            cursors = [c for c in cursors if c[0] < c[1]]
            cursors.sort(key=lambda c: seg[c[0]])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= slack:
                    pivot = k
                    break
            if pivot is None:
                return found
            d = seg[cursors[pivot][0]]
            while pivot + 1 < len(cursors) and seg[cursors[pivot + 1][0]] == d:
                pivot += 1
            near, ends = 0.0, []
            for c in cursors[: pivot + 1]:  # the blocks in which d would stand
                at = c[0]
                last = min(at - (at - 0) % BLOCK + BLOCK, c[1]) - 1
                while last < c[1] - 1 and seg[last] < d:
                    at = last + 1
                    last = min(last + BLOCK, c[1] - 1)
                near += block[at]
                ends.append(seg[last])
            if near >= slack:
                if seg[cursors[0][0]] == d:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += float(imp[c[0]])
                        c[0] += 1
                    if score >= slack:
                        found.append((int(d), score))
                    continue
                goal = d
            else:  # no segment up to the first block's end can reach the threshold
                later = seg[cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else np.iinfo(np.int32).max
                goal = max(min(min(ends) + 1, later), d + 1)
            for c in cursors[: pivot + 1]:
                if seg[c[0]] < goal:
                    c[0] += int(np.searchsorted(seg[c[0] : c[1]], goal))


def segments_of(hashed: np.ndarray) -> list[np.ndarray]:
    """Words of each segment of an item: every SEGMENT words, the last segment flush with the end."""
    return [hashed[i : i + SEGMENT] for i in sorted({*range(0, max(1, len(hashed) - SEGMENT + 1), SEGMENT), max(0, len(hashed) - SEGMENT)})] if len(hashed) else []


@dataclass
class Statistics:
    """Of the segments of a whole test set: how many, their mean length, and in how many each term is."""

    segments: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def statistics(shards: Iterable[list[tuple[int, bytes]]]) -> Statistics:
    """One pass; what is held is a shard and the distinct terms."""
    n, total, terms, df = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for items in shards:
        own = [np.unique(x) for _, t in items for x in segments_of(word_hashes([t])[0])]
        n += len(own)
        total += sum(len(x) for _, t in items for x in segments_of(word_hashes([t])[0]))
        words, place = np.unique(np.concatenate([terms, *own]), return_inverse=True)
        df = np.bincount(place, np.concatenate([df, np.ones(len(place) - len(df))]), len(words)).astype(np.int64)
        terms = words
    return Statistics(n, total / n if n else 1.0, terms, df)


def build(items: list[tuple[int, bytes]], of: Statistics | None = None) -> Index:
    """Index of (item_id, text) rows; each row is an item of its own. ``of``: statistics of the whole set that these are a part of."""
    of = of or statistics([items])
    segments, owner, ids, halves = [], [], [], []
    for item, text in items:
        hashed, _ = word_hashes([text])
        if not len(hashed):
            continue
        middle = -(-len(hashed) // 2)
        parts = (hashed[:middle], hashed[middle:]) if len(hashed) >= 2 * NGRAM else (hashed,)  # a short item must stand there whole
        halves.append([(n := gram_length(len(h)) if len(parts) == 2 else len(h), np.unique(ngrams(h, n))) for h in parts])
        for part in segments_of(hashed):
            segments.append(np.unique(part, return_counts=True))
            owner.append(len(ids))
        ids.append(item)
    length = np.array([c.sum() for _, c in segments], float)
    words = np.concatenate([w for w, _ in segments]) if segments else np.zeros(0, np.uint64)
    tf = np.concatenate([c for _, c in segments]).astype(float) if segments else np.zeros(0)
    seg = np.repeat(np.arange(len(segments)), [len(w) for w, _ in segments]).astype(np.int32)
    terms, place, own_df = np.unique(words, return_inverse=True, return_counts=True)
    df = of.df[np.searchsorted(of.terms, terms)]
    idf = np.log(1 + (of.segments - df + 0.5) / (df + 0.5))
    impact = idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[seg] / of.mean))
    impact /= np.bincount(seg, impact, len(segments))[seg] if len(seg) else 1
    order = np.lexsort((seg, place))
    seg, impact, place = seg[order], impact[order], place[order]
    begin = np.concatenate([[0], np.cumsum(own_df)])
    # Each segment's terms, most frequent first, as long as their impacts add up to SPARE at most.
    often = np.lexsort((place, -df[place], seg))
    sums = np.cumsum(impact[often])
    start = np.concatenate([[0.0], sums])[np.searchsorted(seg[often], np.arange(len(segments)))]
    spare = np.zeros(len(seg), bool)
    spare[often] = sums - start[seg[often]] <= SPARE
    need = THRESHOLD - 1e-9 - np.bincount(seg[spare], impact[spare], len(segments))
    telling = (np.concatenate([[0], np.cumsum(np.bincount(place[~spare], minlength=len(terms)))]), seg[~spare], impact[~spare])
    most = np.maximum.reduceat(impact, begin[:-1]) if len(terms) else impact
    return Index(terms, begin, seg, impact, _block_max(impact, begin), most, np.array(owner, np.int64), ids, halves, telling, need)


def _block_max(impact: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Blocks stand at multiples of BLOCK in the whole array, cut where a term ends."""
    if not len(impact):
        return impact
    cut = np.union1d(np.arange(0, len(impact), BLOCK), begin[:-1])
    size = np.diff(np.append(cut, len(impact)))
    return np.repeat(np.maximum.reduceat(impact, cut), size)


def matches(index: Index, data: list[bytes]) -> Iterator[tuple[int, int, float, float, float]]:
    """(place of the text, item_id, best score, question overlap, answer overlap) of every contaminated pair."""
    if not len(index.terms):
        return
    hashed, counts = word_hashes(data)
    place = np.minimum(np.searchsorted(index.terms, hashed), len(index.terms) - 1)
    known = index.terms[place] == hashed
    begin = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(data)), counts)
    strides = -(-counts // STRIDE)
    first_stride = np.concatenate([[0], np.cumsum(strides)])
    stride = first_stride[text] + (np.arange(len(hashed)) - begin[text]) // STRIDE
    # First bound, of all passages at once: what each stride has of each segment's telling terms; a passage is two strides.
    at, seg_of, impact_of = index.telling
    own = place[known]
    reps = at[own + 1] - at[own]
    hits = np.repeat(at[own] - np.concatenate([[0], np.cumsum(reps)])[:-1], reps) + np.arange(int(reps.sum()))
    n_segments = len(index.need)
    keys, inverse = np.unique(np.repeat(stride[known], reps) * n_segments + seg_of[hits], return_inverse=True)
    have = np.bincount(inverse, impact_of[hits], len(keys))
    after = np.searchsorted(keys, keys + n_segments)
    there = keys[np.minimum(after, len(keys) - 1)] == keys + n_segments if len(keys) else np.zeros(0, bool)
    both = have + np.where(there, have[np.minimum(after, len(keys) - 1)], 0) if len(keys) else have
    enough = index.need[keys % n_segments]
    earlier = keys[have >= enough] // n_segments - 1  # passages that end in a stride which has enough by itself
    texts_of = np.searchsorted(first_stride, np.stack([earlier, earlier + 1]), side="right")
    hopeful = np.union1d(keys[both >= enough] // n_segments, earlier[(texts_of[0] == texts_of[1]) & (earlier >= 0)])
    best: dict[tuple[int, int], float] = {}
    short: dict[tuple[int, int], list[tuple[int, int]]] = {}  # passages of items whose grams are short
    for k in hopeful.tolist():
        t = int(np.searchsorted(first_stride, k, side="right")) - 1
        a = begin[t] + (k - first_stride[t]) * STRIDE
        b = min(a + PASSAGE, begin[t + 1])
        for seg, score in index.search(np.unique(place[a:b][known[a:b]])):
            key = (t, int(index.item[seg]))
            best[key] = max(best.get(key, 0.0), score)
            if min(n for n, _ in index.halves[key[1]]) < NGRAM:
                short.setdefault(key, []).append((int(a), int(b)))
    grams: dict[tuple[int, int, int], np.ndarray] = {}

    def shares(a: int, b: int, item: int) -> list[float]:
        out = []
        for n, own in index.halves[item]:
            if (a, b, n) not in grams:
                grams[a, b, n] = np.unique(ngrams(hashed[a:b], n))
            out.append(float(np.isin(own, grams[a, b, n]).mean()))
        return out

    for (t, item), score in sorted(best.items()):
        found = max((shares(a, b, item) for a, b in short.get((t, item), [(int(begin[t]), int(begin[t + 1]))])), key=min)
        if min(found) >= OVERLAP:
            yield t, index.ids[item], score, found[0], found[-1]


COLUMNS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _searcher(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("decontaminate")
        for b in batches:
            data = b.column(1).to_pylist()
            rows = [(b.column(0)[i + t].as_py(), *rest) for i, j in chunks([len(t) for t in data]) for t, *rest in matches(index.value, data[i:j])]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(cols)], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def _shards(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in ascending item_id, SHARD at a time; those without an id or words are skipped."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).orderBy("item_id", "text")
    held = []
    for r in rows.toLocalIterator():
        held.append((r[0], bytes(r[1])))
        if len(held) == SHARD:
            yield held
            held = []
    if held:
        yield held


def broadcasts(benchmark: DataFrame) -> list:
    """An index for each SHARD items, broadcast. The driver holds one shard at a time, and the terms' counts."""
    context = benchmark.sparkSession.sparkContext
    whole = statistics(_shards(benchmark))
    return [context.broadcast(build(items, whole)) for items in _shards(benchmark)] or [context.broadcast(build([]))]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: every pair of a document and a test item that stands in it.

    Null or empty texts give no pair; rows of one doc_id each give theirs; documents without an id are searched and have a null
    doc_id; test rows that share an id are items of their own; repeated test rows repeat their pairs; very long texts are searched whole,
    passage by passage; other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = texts(docs).select("doc_id", F.col("text").cast("binary").alias("t"))
    parts = [source.mapInArrow(_searcher(held), COLUMNS) for held in broadcasts(benchmark)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (its own columns) in whose text no test item stands. The test is a column, so no row moves.

    Rows with null or empty texts and without a doc_id are kept or dropped by their text alone; repeated rows all stay or all go; an
    empty test set keeps everything.
    """
    small_batches(docs.sparkSession)
    for held in broadcasts(benchmark):

        def clean(t, held=held):
            import pandas as pd

            kept("decontaminate")
            data = [x or b"" for x in t]
            bad = {i + m[0] for i, j in chunks([len(t) for t in data]) for m in matches(held.value, data[i:j])}
            return pd.Series([k not in bad for k in range(len(data))], dtype="bool")

        docs = docs.where(F.pandas_udf(clean, "boolean")(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return docs
