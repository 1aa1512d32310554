"""Budgets, rows and SQL of mixing against a plain allocator, with weights of 0."""

import random
from collections import Counter

import pytest

from sextant.llm import mixing

WORDS = [f"w{k}" for k in range(50)]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def fill(given, children):
    """Water level by halving: children are (weight, cap)."""
    low, high = 0.0, max([c / w for w, c in children if w > 0], default=0.0)
    if sum(c for w, c in children if w > 0) <= given:
        return [c if w > 0 else 0.0 for w, c in children]
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for w, c in children) < given else (low, mid)
    return [min(c, high * w) for w, c in children]


def brute_budgets(leaves, plan):
    """leaves: {(domain, lang, source): tokens} -> {leaf: budget}, from the root down."""
    weigh = lambda k, name: plan.weights.get(mixing.LEVELS[k], {}).get(name, 1.0)
    caps = {p: n * plan.epochs if all(weigh(k, x) > 0 for k, x in enumerate(p)) else 0.0 for p, n in leaves.items()}
    out = {(): sum(leaves.values()) * plan.share}
    for k in range(3):
        for parent in [p for p in out if len(p) == k]:
            own = sorted({p[: k + 1] for p in leaves if p[:k] == parent})
            out.update(zip(own, fill(out[parent], [(weigh(k, c[-1]), sum(v for p, v in caps.items() if p[: k + 1] == c)) for c in own]), strict=True))
    return {p: b for p, b in out.items() if len(p) == 3}


PLANS = [
    mixing.Plan(weights={"domain": {"src1": 5.0}, "lang": {"de": 0.0}}, share=0.6, epochs=2),
    mixing.Plan(weights={"source": {"src0-a": 0.0, "src1-b": 3.0}}, share=0.5, epochs=1),
    mixing.Plan(weights={"domain": {"src0": 0.0}}, share=2.5, epochs=3),
    mixing.Plan(weights={}, share=0.9, epochs=3),
    mixing.Plan(weights={"lang": {"en": 0.0, "de": 0.0, "": 0.0}}, share=0.5),
]


@pytest.mark.parametrize("plan", PLANS)
def test_budgets_and_rows_against_brute_force_and_sql(spark, plan):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(4)
    rows = [(k, text(k, r.choice([0, 3, 20, 90])), r.choice(["en", "de", None]), f"src{r.choice('0012')}-{r.choice('ab')}") for k in range(90)] + [(90, None, "en", None), (91, "x", None, "src1-b"), (None, "a b c", "en", "src0-a"), (5, text(5, 9), "en", "src1-b"), (5, text(6, 9), "en", "src1-b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    leaves = Counter()
    for _, t, lang, source in rows:
        leaves[(source or "")[:4], lang or "", source or ""] += len((t or "").split())
    counted = docs.select(*[c.alias(k) for k, c in mixing.leaf_columns().items()], mixing.F.size(mixing.F.split(mixing.F.trim(mixing.F.regexp_replace(mixing.F.coalesce("text", mixing.F.lit("")), "\\s+", " ")), " ")).alias("n"), "text")
    counted = counted.withColumn("n_tokens", mixing.F.when(mixing.F.trim(mixing.F.coalesce("text", mixing.F.lit(""))) == "", 0).otherwise(mixing.F.col("n")))
    got = {(b.domain, b.lang, b.source): b.budget for b in mixing.budgets(counted, plan).collect()}
    want = brute_budgets(leaves, plan)
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=1e-3) for p in want)
    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    key = lambda x: tuple((v is None, v) for v in x)
    sql = c.execute("SELECT doc_id, domain, lang, source, epoch, n_tokens FROM (" + mixing.sql(plan) + ")").fetchall()
    assert sorted(map(tuple, mixing.mix(docs, plan).collect()), key=key) == sorted(sql, key=key)
