"""The whole pipeline and each of its stages against plain Python, on a small folder of tables with every odd case."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import brute as brute_leaks
from test_documents import brute_components
from test_mixing import brute_budgets

import corpus_pipeline as cp
from sextant.llm import mixing, quality

WORDS = [f"w{k}" for k in range(300)]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BENCH = [(k, text(900 + k, 30 + 11 * k)) for k in range(6)] + [(6, None), (7, "")]


def rows():
    r = random.Random(0)
    out = []
    for k in range(240):
        t = text(k, 30 + k % 90)
        if k % 4 == 0:
            t = t.replace(" ", "!! ")
        elif k % 9 == 1:
            t = f"{t} {BENCH[k % 6][1]} {text(k + 7000, 20)}"
        elif k % 7 == 2:
            t = out[r.randrange(len(out))][1]
        out.append((k, t, r.choice(["en", "de", None]), f"src{k % 3}-{k % 2}", len(t)))
    return out + [(300, None, "en", "src1-0", 0), (301, "", None, None, 0), (302, " \n", "de", "src0-0", 2), (303, text(5, 6000), "en", "src2-1", 9), (5, out[5][1], "en", "src2-1", 3), (None, text(6, 40), "en", "src0-0", 4), (None, None, None, None, None)]


ROWS = rows()
LABELS = [(k, int(k % 4 > 0), 0) for k in range(0, 240, 2)] + [(None, 1, 0), (3, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}"


def brute_keep_first(docs):
    least = Counter((i, c) for i, _, c in brute_components([(r[0], r[1]) for r in docs]))
    own = {i for i, c in least if i is not None and i == c}
    out, seen = [], set()
    for r in docs:
        if r[0] is None or r[0] in own and (r[0], r[1] or "") not in seen:
            seen.add((r[0], r[1] or ""))
            out.append(r)
    return out


def brute_mix(docs, plan):
    levels = lambda r: ((r[3] or "")[:4], r[2] or "", r[3] or "")
    n = lambda r: len((r[1] or "").split())
    leaves = Counter()
    for r in docs:
        leaves[levels(r)] += n(r)
    budgets = brute_budgets(leaves, plan)
    out = []
    for leaf, avail in leaves.items():
        own = [r for r in docs if levels(r) == leaf]
        whole = int(budgets[leaf] / avail + 1e-9) if avail else 0
        rest = budgets[leaf] - whole * avail
        key = lambda r, e=whole: hashlib.md5(f"{plan.seed}:{e}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
        by_key = Counter()
        for r in own:
            by_key[key(r)] += n(r)
        before = {k: sum(v for x, v in by_key.items() if x < k) for k in by_key}
        out += [r for r in own if whole or rest > 1e-6 and before[key(r)] < rest]
    return out


def test_run_against_plain_python(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {(r.doc_id, r.text) for r in cp.STAGES[0][1](spark, docs, folder).collect()}
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [r for r in ROWS if model.score(quality.Ngrams().of((r[1] or "").encode())) >= 0.7]
    assert kept == {(r[0], r[1]) for r in left} and len(left) > 100 and sum("!!" in (r[1] or "") for r in left) < 10
    left = brute_keep_first(left)
    bad = {i for i, *_ in brute_leaks([(k, r[1]) for k, r in enumerate(left)], BENCH)}
    assert bad
    left = brute_mix([r for k, r in enumerate(left) if k not in bad], cp.MIX)
    t = Tokenizer.from_file(cp.vocabulary())
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in left]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    got = cp.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, folder, k):
    """Empty tables, only nulls, and columns that clash with names inside."""
    name, stage = cp.STAGES[k]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.selectExpr("*", "1 as budget", "'x' as epoch", "2 as concerned", "3 as text_hash", "4 as own_0", "5 as domain")
    none = stage(spark, more.limit(0), folder)
    assert none.count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, docs.schema)
    got = stage(spark, nulls, folder)
    assert got.count() in (0, 2)
    some = stage(spark, more, folder)
    if k < 4:
        assert some.columns == more.columns and 0 < some.count() <= len(ROWS) and none.columns == more.columns
    else:
        assert some.count() == len(ROWS)


def test_mix_of_one_epoch_is_a_choice(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = mixing.keep_mix(docs, cp.MIX)
    assert Counter(map(tuple, got.collect())) == Counter(brute_mix(ROWS, cp.MIX))
