"""Fingerprints, tokens, mixing, joins, decontamination and classifiers on small tables against plain Python, with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from sextant.llm import components, decontaminate, jaccard_join, merkle, mixing, quality, shingles, tokens, toxicity
from sextant.llm.queries import vocabulary

WORDS = [f"w{k}" for k in range(400)]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", "\n"]) for _ in range(n)).replace("\n ", "\n")


def near(t, seed, share=0.02):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else "Changed" for w in t.split(" "))


LONG = text(99, 9000)
TEXTS = [text(i, 60 + i) for i in range(30)]
ROWS = (
    [(i, t) for i, t in enumerate(TEXTS)]
    + [(30 + i, near(TEXTS[i % 5], i)) for i in range(20)]
    + [(50 + i, TEXTS[7]) for i in range(6)]
    + [(60, None), (61, ""), (62, " \n\t"), (63, "one two"), (64, "ONE  two"), (65, LONG), (66, near(LONG, 5, 0.01)), (67, "naïve 😀 café " * 9), (70, "same"), (70, "same"), (None, TEXTS[3]), (None, None)]
)


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names that operators use inside."""
    rows = [(i, t, ("en", "de", None)[(i or 0) % 3], f"src{(i or 0) % 4}", len(t or ""), 1, "x") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class int, key string").repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(50)] + [(3, None, None), (None, 1, 1), (4, 0, 1), (5, 7, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def in_order():
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    return sorted(ROWS, key=key)


def test_token_files(docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    path = "file://" + str(tmp_path / "ids")
    tokens.write_tokens(docs, path, vocabulary(), docs_per_file=16)
    got = sorted(tokens.digest(tokens.read_tokens(docs.sparkSession, path)).collect(), key=lambda r: r.start)
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in ROWS]
    assert [r.doc_id for r in got] == [i for i, _ in in_order()]
    start = 0
    left = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    for r in got:
        assert r.start == start
        left[r.doc_id, r.n_tokens, r.ids_crc32] -= 1
        start += r.n_tokens
    assert not +left
    meta = pq.ParquetFile(next((tmp_path / "ids").glob("*.parquet"))).metadata.row_group(0)
    assert meta.column(4).has_offset_index and "DELTA_BINARY_PACKED" in meta.column(4).encodings


@pytest.mark.parametrize("t", ["a  b", "a \nb", "  x", "x  ", "a  b", "it's. he'll,o'.", "é,è.x×,÷.", "<|endoftext|> a", "x\t y", "\n\n a", "a　b c", "don't-stop_it ''x"])
def test_chunks_change_no_ids(t):
    e = tokens.Encoder(vocabulary())
    flat, count = e.encode_texts([t, "x", t])
    plain = e.plain([t, "x", t])
    assert flat.tolist() == np.concatenate(plain).tolist() and count.tolist() == [len(p) for p in plain]


def test_added_tokens_keep_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    rows = list(enumerate(["see <|endoftext|> now", "plain words", "ends in <|endof", "text|> begins", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "", "see it now"]))
    ids = [[*t.encode(x, add_special_tokens=False).ids, 0] for _, x in rows]
    assert ids[0] == [3826, 220, 50256, 783, 0]
    path = "file://" + str(tmp_path / "ids")
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, vocabulary())
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert [list(r.tokens) for r in got] == ids and [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]


def brute_sets(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return sets


def brute_links(rows):
    sets = brute_sets(rows)
    return Counter((i, sum(b != a and bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for b in range(len(rows)))) for a, (i, _) in enumerate(rows))


def brute_components(rows):
    sets = brute_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [2048, 4])
def test_components(docs, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.cluster(docs).collect())
    assert got == brute_components(ROWS)


@pytest.mark.parametrize("tile", [2048, 4])
def test_every_link(docs, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    got = jaccard_join.linked(docs).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == brute_links(ROWS)
    pairs, members = jaccard_join.links(docs)
    at = {}
    for r in members.collect():
        at.setdefault(r["class"], []).append(r.doc_id)
    found = {(i, j) for r in pairs.collect() for i in at[r.class_u] for j in at[r.class_v]}
    assert len(found) and all(u != v for u, v in found)


def test_copies_without_ids(spark):
    """A class of rows without ids connects others."""
    base = text(5, 100).split(" ")
    rows = [(1, " ".join(base)), (None, " ".join([*base[:-5], *"v w x y z".split()])), (2, " ".join([*base[:-5], *"v w x y z".split(), *"a b c d e f g h i j k l m n o p q r".split()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.cluster(docs).collect()) == brute_components(rows)


def test_one_of_each_component_stays(docs):
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for (i, n, c) in brute_components(ROWS) if i is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 2


def test_different_texts_of_one_id_stay(spark):
    rows = [(1, TEXTS[0]), (1, TEXTS[1]), (2, TEXTS[0]), (1, TEXTS[0]), (3, ""), (3, None), (3, " "), (4, TEXTS[1]), (5, TEXTS[2])]
    docs = spark.createDataFrame([(*r, 1, 2, True) for r in rows], "doc_id long, text string, bucket int, text_hash int, concerned boolean")
    got = Counter((r.doc_id, r.text or "") for r in jaccard_join.keep_first(docs).collect())
    assert got == Counter([(1, TEXTS[0]), (1, TEXTS[1]), (3, ""), (3, " "), (5, TEXTS[2])])
    assert jaccard_join.keep_first(docs.limit(0)).count() == 0


def test_tree_bound_loses_nothing():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 62, 5000).astype(np.uint64)
    sets = []
    for k in range(120):
        base = pool[(k % 6) * 700 : (k % 6) * 700 + 150 + 40 * (k % 5)]
        sets.append(np.unique(r.choice(base, int(len(base) * r.uniform(0.8, 1.0)), replace=False)))
    points = np.stack([jaccard_join.point(s) for s in sets])
    tree = jaccard_join.RTree(points, np.array([len(s) for s in sets]))
    for i in range(len(sets)):
        near_ones = set(tree.query(i).tolist())
        for j in range(i + 1, len(sets)):
            a, b = sets[tree.order[i]], sets[tree.order[j]]
            if jaccard_join.is_link(len(np.intersect1d(a, b)), len(a), len(b)):
                assert j in near_ones


def test_star_contraction(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(20)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}


def test_leaks(spark, docs):
    items = [(0, " ".join(LONG.split()[4000:4040])), (1, text(500, 40)), (2, None), (3, ""), (4, "w1 w2"), (5, TEXTS[2]), (6, " ".join(text(501, 70).split()))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = [(80, f"{text(7, 200)} {items[1][1]} {text(8, 130)}"), (81, near(items[6][1], 3, 0.03)), (82, f"{text(9, 100)} {' '.join(items[1][1].split()[:12])}")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(more, bench).collect()}
    want = {(i, k) for i, t in ROWS + planted for k, x in items if x and f" {' '.join(x.split())} " in f" {' '.join((t or '').split())} "}
    assert want <= got and {i for i, _ in got - want} <= {81, 65, 66, *range(30, 50)} and (81, 6) in got and 82 not in {i for i, _ in got}
    kept = decontaminate.drop_leaks(more, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in ROWS + planted if i not in {x for x, _ in got})


def test_wand_against_all_scores():
    index = decontaminate.build([(i, text(i, 30 + i % 20).encode()) for i in range(80)])
    r = np.random.default_rng(0)
    for _ in range(60):
        own = np.unique(np.concatenate([r.integers(0, len(index.terms), 50), np.flatnonzero(r.random(len(index.terms)) < 0.02)]))
        score = np.zeros(len(index.item))
        for t in own:
            score[index.segment[index.begin[t] : index.begin[t + 1]]] += index.impact[index.begin[t] : index.begin[t + 1]]
        for limit in (0.15, 0.3, 0.5):
            assert sorted(s for s, _ in index.search(own, limit)) == np.flatnonzero(score >= limit - 1e-9).tolist()


def test_mixture(docs):
    plan = mixing.Plan(weights={"domain": {"src1": 5.0}, "lang": {"de": 0.0}}, share=0.6, epochs=2)
    got = mixing.mix(docs, plan).collect()
    n = lambda t: len([x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x])
    total, all_ = sum(r.n_tokens for r in got), sum(n(t) for _, t in ROWS)
    assert 0.5 * all_ < total < 0.8 * all_ + n(LONG)
    assert not [r for r in got if r.lang == "de" and r.n_tokens]
    per = Counter((r.doc_id, r.n_tokens, r.epoch) for r in got)
    assert max(r.epoch for r in got) <= 1 and all(per[i, k, 0] for (i, k, e) in per if e == 1)
    kept = mixing.keep_mix(docs, mixing.Plan(share=0.5, epochs=1))
    assert kept.columns == docs.columns and 0 < kept.count() < len(ROWS)


def test_classifiers(docs, labels):
    for found in (quality.classify(docs, labels), toxicity.classify(docs, labels)):
        rows = found.collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS)
        assert all(0 <= r.score <= 1 for r in rows) and all((r.held_out is None) == (r.doc_id is None) for r in rows)
    one = labels.where("quality = 1")
    assert {r.predicted for r in quality.classify(docs, one).collect()} <= {0, 1}
    assert toxicity.classify(docs, labels.limit(0)).count() == len(ROWS)


def test_quality_learns():
    r = random.Random(0)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(80))
    data = [(good().encode(), 1) if r.random() < 0.7 else ((good().replace(" ", "!! ")).encode(), 0) for _ in range(400)]
    m, g = quality.fit(data[:300]), quality.Ngrams()
    assert np.mean([(m.score(g.of(t)) >= 0.7) == y for t, y in data[300:]]) > 0.97


def test_toxicity_learns_misspellings():
    r = random.Random(0)

    def one(bad, words=("wretched", "vermin")):
        w = [r.choice(WORDS) for _ in range(120)]
        if bad:
            w[r.randrange(120)] = r.choice(words)
        return " ".join(w).encode(), int(bad)

    m = toxicity.fit([one(r.random() < 0.4) for _ in range(600)])
    s = toxicity.Scorer(m)
    assert np.mean([(s.score(t) >= 0.5) == y for t, y in (one(r.random() < 0.5) for _ in range(200))]) > 0.95
    assert np.mean([s.score(one(True, ("wretchedd", "verrmin"))[0]) for _ in range(40)]) > np.mean([s.score(one(False)[0]) for _ in range(40)]) + 0.2


@pytest.mark.parametrize("blank", ["_", "/", ",", "\u00a0", "\u3000"])
def test_toxicity_of_long_words(blank):
    r = random.Random(1)

    def one(bad):
        w = [r.choice(WORDS) for _ in range(120)]
        if bad:
            w[r.randrange(40, 120)] = r.choice(("wretched", "vermin"))
        return w

    joined = [one(k % 2) for k in range(80)]
    s = toxicity.Scorer(toxicity.fit([(" ".join(one(k % 2)).encode(), k % 2) for k in range(600)]))
    got = [s.score(blank.join(w).encode()) for w in joined]
    assert np.mean(got[1::2]) > np.mean(got[::2]) + 0.2
    m = toxicity.Scorer(toxicity.fit([(blank.join(one(k % 2)).encode(), k % 2) for k in range(600)]))
    assert np.mean([(m.score(blank.join(w).encode()) >= 0.5) == k % 2 for k, w in enumerate(joined)]) > 0.9


def test_pieces_hold_every_ngram():
    for n in (97, 100, 103, 104, 105, 200, 1001):
        w = bytes(random.Random(n).choice(b"abcdefgh") for _ in range(n))
        got = toxicity.words_of(b"short " + w + b" " + b"x" * 96)
        assert got[0] == b"short" and got[-1] == b"x" * 96
        assert {w[k : k + 6] for k in range(n - 5)} == {p[k : k + 6] for p in got[1:-1] for k in range(len(p) - 5)}
    assert toxicity.words_of(b"a  b") == [b"a", b"b"] and toxicity.words_of(b"") == []


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert merkle.compare_with_edit(none).count() == quality.classify(none, labels).count() == mixing.mix(none).count() == jaccard_join.cluster(none).count() == tokens.encode_and_read(none, vocabulary()).count() == 0
    assert decontaminate.leaks(docs, bench).count() == decontaminate.leaks(none, bench).count() == 0


def test_shingles():
    got = list(shingles.sets([b"", b" \n", b"a b", b"A  B", b"a b c d e", b"\ta b c d  e f "]))
    assert [len(s) for s in got] == [0, 0, 1, 1, 1, 2] and got[2][0] == got[3][0] and got[4][0] in got[5]
