"""Leaks against plain Python: BM25 from dictionaries, every passage against every segment, n-grams as tuples."""

import math
import random
import re
from collections import Counter

import pytest

from sextant.llm import decontaminate as d

WORDS = [f"w{k}" for k in range(300)]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def brute(docs, items):
    items = [(i, words(t)) for i, t in items if i is not None and words(t)]
    segments = [(k, w[a : a + 48]) for k, (_, w) in enumerate(items) for a in sorted({*range(0, max(1, len(w) - 47), 48), max(0, len(w) - 48)})]
    mean = sum(len(s) for _, s in segments) / max(1, len(segments))
    df = Counter(x for _, s in segments for x in set(s))
    idf = {x: math.log(1 + (len(segments) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    worth = []
    for k, s in segments:
        own = {x: idf[x] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(s) / mean)) for x, c in Counter(s).items()}
        worth.append((k, {x: v / sum(own.values()) for x, v in own.items()}))
    out = Counter()
    for doc, t in docs:
        w = words(t)
        best, where = {}, {}
        for a in range(0, len(w), 48):
            have = set(w[a : a + 96])
            for k, own in worth:
                score = sum(v for x, v in own.items() if x in have)
                if score >= 0.5 - 1e-9:
                    best[k] = max(best.get(k, 0), score)
                    where.setdefault(k, []).append((a, a + 96))
        for k, score in best.items():
            own = items[k][1]
            middle = -(-len(own) // 2)
            halves = [own[:middle], own[middle:]] if len(own) >= 10 else [own]
            sizes = [max(1, min(5, (len(h) + 1) // 3)) if len(halves) == 2 else len(h) for h in halves]
            spans = set(where[k]) if min(sizes) < 5 else {(0, len(w))}
            gram = lambda x, n: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
            shares = max((tuple(len(gram(h, n) & gram(w[a:b], n)) / len(gram(h, n)) for h, n in zip(halves, sizes, strict=True)) for a, b in spans), key=min)
            if min(shares) >= 0.5:
                out[doc, items[k][0], round(score, 6), round(shares[0], 6), round(shares[-1], 6)] += 1
    return out


ITEMS = [(k, text(1000 + k, n)) for k, n in enumerate([5, 9, 10, 11, 14, 20, 27, 30, 47, 48, 49, 71, 72, 73, 95, 96, 97, 150])]
ITEMS += [(5, text(2000, 26)), (None, text(2001, 30)), (40, None), (41, " \n"), (42, ITEMS[7][1]), (43, "one two")]


def edited(t, seed, n):
    r, w = random.Random(seed), t.split()
    for k in r.sample(range(len(w)), min(n, len(w))):
        w[k] = "Edited"
    return " ".join(w)


def documents():
    rows = [(k, text(k, 20 + 17 * k)) for k in range(20)]
    for k, (_, t) in enumerate(x for x in ITEMS if x[1] and x[1].strip()):
        rows += [(100 + k, f"{text(k + 300, 7 * k)} {t} {text(k + 400, 60)}"), (200 + k, f"{text(k + 500, 31)}\n{edited(t, k, 1)} {text(k + 600, 3 * k)}"), (300 + k, f"{text(k, 40)} {edited(t, k, len(t.split()) // 3)}")]
        rows += [(400 + k, " ".join(t.split()[: len(t.split()) // 2]) + " " + text(k, 30)), (500 + k, " ".join(t.split()[-24:]))]
    return rows + [(100, rows[40][1]), (None, ITEMS[12][1]), (901, None), (902, ""), (903, text(77, 5000) + " " + ITEMS[17][1].upper())]


def test_statistics_of_shards_are_those_of_the_whole():
    items = [(i, t.encode()) for i, t in ITEMS if i is not None and t]
    whole, parts = d.statistics([items]), d.statistics([items[:7], items[7:8], [], items[8:]])
    assert (whole.segments, whole.terms.tolist(), whole.df.tolist()) == (parts.segments, parts.terms.tolist(), parts.df.tolist()) and whole.mean == pytest.approx(parts.mean)


@pytest.mark.parametrize("shard", [20_000, 5])
def test_leaks_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(d, "SHARD", shard)
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in documents()], "doc_id long, text string, score double, item_id string").repartition(3)
    bench = spark.createDataFrame([(*r, 3) for r in ITEMS], "item_id long, text string, doc_id int")
    got = Counter((r.doc_id, r.item_id, round(r.score, 6), round(r.question_overlap, 6), round(r.answer_overlap, 6)) for r in d.leaks(docs, bench).collect())
    want = brute(documents(), ITEMS)
    assert got == want
    planted = {(100 + k, i) for k, (i, t) in enumerate(x for x in ITEMS if x[1] and x[1].strip()) if i is not None}
    assert planted <= {(x[0], x[1]) for x in got}
    once = {(200 + k, i) for k, (i, t) in enumerate(x for x in ITEMS if x[1] and x[1].strip()) if i is not None and len(t.split()) >= 10}
    assert once <= {(x[0], x[1]) for x in got}
    kept = d.drop_leaks(docs, bench)
    texts_of = {t for i, t in documents() if i is None}
    bad = {x[0] for x in want}
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) <= Counter(i for i, _ in documents() if i not in bad) + Counter({100: 1}) and texts_of


def test_empty_sides(spark):
    docs = spark.createDataFrame(documents()[:3], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    assert d.drop_leaks(docs, none).count() == 3 and d.drop_leaks(docs.limit(0), bench).count() == 0
    assert d.leaks(docs, none).count() == d.leaks(docs.limit(0), bench).count() == 0
