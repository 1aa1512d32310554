"""Classifiers against plain versions of their parts, and on the given tables; selective reads of token files."""

import glob
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from sextant.llm import quality, tokens, toxicity
from sextant.llm.common import table
from sextant.llm.queries import vocabulary

DATA = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y > 0].sum() - (y > 0).sum() * ((y > 0).sum() - 1) / 2) / ((y > 0).sum() * (y == 0).sum())


def test_log_count_ratio():
    rows, y = [np.array([1, 2]), np.array([2, 3]), np.array([2])], np.array([1, 0, 1])
    got = quality.log_count_ratio(rows, y)
    n = 1 << quality.BITS
    want = {1: np.log(2 / (n + 3)) - np.log(1 / (n + 2)), 2: np.log(3 / (n + 3)) - np.log(2 / (n + 2)), 3: np.log(1 / (n + 3)) - np.log(2 / (n + 2))}
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())


def test_dual_descent_reaches_the_least_loss():
    """The primal loss at the found weights is that of a long plain subgradient descent, and the dual's is as large."""
    r = np.random.default_rng(0)
    rows = [np.flatnonzero(r.random(30) < 0.3) for _ in range(40)]
    rows = [x if len(x) else np.array([0]) for x in rows]
    y = (r.random(40) < 0.5).astype(int)
    ratio = np.zeros(1 << quality.BITS, np.float32)
    ratio[:30] = r.normal(0, 1, 30)
    cost = np.full(40, 0.7)
    w, bias = quality.dual_coordinate_descent(rows, ratio, y, cost, epochs=2000)
    dense = np.zeros((40, 31))
    for i, x in enumerate(rows):
        v = ratio[x].astype(float)
        dense[i, x] = v / (np.sqrt((v * v).sum()) + 1e-9)
    dense[:, 30] = 1
    sign = np.where(y > 0, 1.0, -1.0)
    loss = lambda u: 0.5 * u @ u + (cost * np.maximum(0, 1 - sign * (dense @ u))).sum()
    found = np.append(w[:30], bias)
    u, best = np.zeros(31), np.inf
    for k in range(1, 20_000):
        live = sign * (dense @ u) < 1
        u = u - (u - (cost * sign * live) @ dense) / (k + 1)
        best = min(best, loss(u))
    assert loss(found) <= best + 1e-3


def plain_score(model, text):
    """Worst window by loops."""
    words, values = [], []
    for w in toxicity.words_of(text):
        if not words or w != words[-1]:
            words.append(w)
    for w in words:
        buckets, n = toxicity.subwords([w])
        values.append(sum(float(model.vectors[b].astype(float) @ (model.softmax[1] - model.softmax[0])) for b in buckets[: n[0]]) / n[0])
    starts = sorted({*range(0, max(1, len(values) - toxicity.WINDOW + 1), toxicity.STRIDE), max(0, len(values) - toxicity.WINDOW)})
    worst = max((sum(values[a : a + toxicity.WINDOW]) / min(toxicity.WINDOW, len(values)) for a in starts), default=0.0) if values else 0.0
    return 1 / (1 + np.exp(-(model.slope * worst + model.offset)))


def test_toxicity_is_the_softmax_of_the_worst_bag():
    r = np.random.default_rng(1)
    model = toxicity.ToxicityModel(r.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), r.normal(0, 1, (2, toxicity.DIM)), np.zeros(2), 1.3, -0.2)
    scorer, draw = toxicity.Scorer(model), random.Random(2)
    for n in (0, 1, 5, 12, 13, 16, 17, 90):
        text = " ".join(draw.choice(["Idiot!", "fine", "fine", "na\u00efve", "x" * 150, "(a)", "\u4e2d\u6587"]) for _ in range(n)).encode()
        assert scorer.score(text) == pytest.approx(plain_score(model, text), abs=1e-4)


def test_distinct_ngrams_of_a_word():
    """Every n-gram of 3 to 6 bytes between the marks, and the word itself; case and marks at its edges don't count."""
    for w in (b"a", b"idiot", b"Idiot,", b"..", "na\u00efve".encode()):
        buckets, n = toxicity.subwords([w])
        bare = b"^%b$" % (w.lower().strip(toxicity.STRIP) or w)
        assert n[0] == len(buckets) == 1 + sum(max(0, len(bare) - k + 1) for k in range(3, 7))
    one, many = toxicity.subwords([b"alpha"])[0], toxicity.subwords([b"beta", b"alpha", b"gamma"])
    assert sorted(one) == sorted(many[0][many[1][0] : many[1][0] + many[1][1]])


def test_slices_change_no_words(monkeypatch):
    texts = [" ".join(random.Random(k).choices([f"w{j}" for j in range(90)], k=60)).encode() for k in range(9)]
    whole = toxicity.indexed(texts)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    parts = toxicity.indexed(texts)
    assert all((a == b).all() for a, b in zip(whole[0], parts[0], strict=True)) and (whole[1] == parts[1]).all() and (whole[2] == parts[2]).all()


@given
@pytest.mark.parametrize("make, label, mod, held, least, accuracy", [(quality, "quality", 4, 2, 0.95, 0.9), (toxicity, "toxic", 5, 0, 0.75, 0.88)])
def test_held_out_rows_of_the_given_tables(spark, make, label, mod, held, least, accuracy):
    rows = make.classify(table(spark, DATA, "documents"), table(spark, DATA, "labels")).join(table(spark, DATA, "labels"), "doc_id").where("held_out").select("doc_id", "score", "predicted", label).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % mod == held for r in rows)
    score, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    assert auc(score, y) >= least and np.mean([r.predicted == r[label] for r in rows]) >= accuracy


def test_labelled_sample_is_bounded_in_bytes(spark):
    from sextant.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(k, "x" * (100 * k)) for k in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, toxic int")
    for most in (50, 1000, 9000, 10**6):
        got = labelled_sample(docs, labels, "toxic", 5, 0, 30, most)
        assert sum(len(t) for t, _ in got) <= most and len(got) <= 30 and all(y == len(t) // 100 % 2 for t, y in got)
    assert len(labelled_sample(docs, labels, "toxic", 5, 0, 30)) == 30 or len(got) <= 30


def test_selective_reads(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 9)) for k in range(3000)], "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/ids"
    tokens.write_tokens(docs, path, vocabulary(), docs_per_file=500)
    everything = {r.doc_id: list(r.tokens) for r in tokens.read_tokens(spark, path).collect()}
    some = tokens.tokens_between(spark, path, 700, 720)
    assert {r.doc_id: list(r.tokens) for r in some.collect()} == {k: everything[k] for k in range(700, 721)}
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,700), LessThanOrEqual(doc_id,720)]" in plan
    narrow = tokens.metadata(spark, path)
    assert "tokens:array" not in narrow._jdf.queryExecution().toString().split("ReadSchema:")[-1] and narrow.count() == 3000
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/ids/*.parquet")]
    spans = sorted((f.metadata.row_group(0).column(1).statistics.min, f.metadata.row_group(f.num_row_groups - 1).column(1).statistics.max) for f in files if f.metadata.num_rows)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) >= 5
    assert all(f.metadata.row_group(0).column(1).has_column_index for f in files if f.metadata.num_rows)


MEMORY = """
import random, re
from sextant.llm import quality, tokens
from sextant.llm.queries import vocabulary

def used():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def sample(*_):
    r = random.Random(0)
    return [(" ".join("w%d" % r.randrange(3000) for _ in range(300)).encode(), k % 2) for k in range(800)]

quality.labelled_sample, path = sample, vocabulary()
a = used()
model = quality.train(None, None)
b = used()
tokens.vocabulary_size(path)
print(b - a, used() - b)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from /proc")
def test_the_driver_keeps_little_memory():
    """A trained model is 8 MB; what training and the vocabulary needed besides goes back to the system."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}
    out = subprocess.run([sys.executable, "-c", MEMORY], env=env, check=True, capture_output=True, text=True).stdout.split()
    training, size = map(float, out[-2:])
    assert training < 20 and size < 10
