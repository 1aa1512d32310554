"""Language-model scores against a plain model, and properties of the parts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sextant.llm import ppm


def train_of(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


class Plain:
    def __init__(self, texts):
        self.c = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        for t in texts:
            h = (0,) * ppm.ORDER
            for s in [*t, 256]:
                for k in range(ppm.ORDER + 1):
                    self.c[k][h[ppm.ORDER - k :]][s] += 1
                h = (*h[1:], s)

    def p(self, h, s):
        gone, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            own = {a: b for a, b in self.c[k].get(h[ppm.ORDER - k :], {}).items() if a not in gone}
            if not own:
                continue
            n, d = sum(own.values()), len(own)
            if s in own:
                return p * own[s] / (n + d)
            p *= d / (n + d)
            gone |= set(own)
        return p / max(1, 257 - len(self.c[0].get((), {})))

    def score(self, t):
        h, out = (0,) * ppm.ORDER, 0.0
        for s in [*t, 256]:
            out += math.log10(self.p(h, s))
            h = (*h[1:], s)
        return out


ROWS = [(i, "".join(random.Random(i).choice("ab cAB é") for _ in range(i % 37))) for i in range(60)] + [(60, None), (61, ""), (None, "abc abc"), (7, "ab"), (7, "ab"), (62, "long " * 3000)]


def test_against_plain(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in ROWS], "doc_id long, text string, score double")
    data = [(i, (t or "").encode().lower()) for i, t in ROWS]
    learn = [t for i, t in data if train_of(i)]
    model, words = Plain(learn), Counter(w for t in learn for w in [*re.split(rb"[\x20\x09-\x0D]+", t), None] if w != b"")
    n, v = sum(words.values()), len(words)
    want = []
    for i, t in data:
        own = [*[w for w in re.split(rb"[\x20\x09-\x0D]+", t) if w], None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((i, len(own), sum(words[w] > 0 for w in own), n, round(base, 6), round(model.score(t), 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ppm.score(docs).collect()]
    key = lambda r: (r[0] is None, r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-5) and a[5] == pytest.approx(b[5], abs=1e-5)


def test_is_a_distribution():
    texts = [b"abracadabra", b"abra cad", b"banana"]
    keys, count = ppm.tally(texts, np.ones(3))
    low = Counter()
    for t in texts:
        for a, b, c in zip([0, 0, *t], [0, *t], [*t, 256], strict=False):
            low[a << 17 | b << 9 | c] += 1
    low = (np.array(sorted(low), np.uint64), np.array([low[k] for k in sorted(low)]))
    own = keys < ppm.WORD_BIT
    for context in (b"abrac", b"zzzzz", b"\0\0\0\0b", b"banan"):
        wanted = (np.uint64(int.from_bytes(context, "big")) << np.uint64(9)) | np.arange(257, dtype=np.uint64)
        assert (10 ** ppm.costs(wanted, keys[own], count[own], low)).sum() == pytest.approx(1.0)


def test_a_block_for_each_partition(spark):
    for n in (1, 2, 7, 211):
        labels = ppm.apart(spark, n)
        got = spark.createDataFrame([(k,) for k in labels], "block int").repartition(n, "block").rdd.glom().map(len).collect()
        assert len(set(labels)) == n and got == [1] * n


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_pieces_change_nothing(monkeypatch, chunk):
    texts = [b"", b"abc", b"one two  three\n" * 9, b"x" * 90, b" y" * 40 + b" "]
    whole = ppm.tally(texts, np.array([1, 0, 1, 1, 0]))
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    assert max(len(p.text) for p in ppm.pieces(texts)) < 95 and len(ppm.pieces(texts)) > 5
    parts = ppm.tally(texts, np.array([1, 0, 1, 1, 0]))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_scores_of_pieces(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    whole = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ppm.score(docs).collect())
    score = ppm._score

    def small(*args):
        run = score(*args)

        def inner(left, right):
            ppm.CHUNK = 50  # in the worker
            return run(left, right)

        return inner

    monkeypatch.setattr(ppm, "_score", small)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ppm.score(docs).collect()) == whole


@pytest.mark.parametrize("tasks", [20_000, 2])
def test_many_blocks_in_few_tasks(spark, monkeypatch, tasks):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    one = Counter((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ppm.score(docs).collect())
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 900)
    monkeypatch.setattr(ppm, "MOST_TASKS", tasks)
    assert Counter((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ppm.score(docs).collect()) == one


def test_empty_tables(spark):
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = ppm.score(spark.createDataFrame([(10, None)], "doc_id long, text string")).collect()
    assert len(only) == 1 and only[0].n_tokens == 1
