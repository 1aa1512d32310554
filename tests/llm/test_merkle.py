"""Fingerprints against a plain Merkle tree, edited texts against slices, and the descent to an edit."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sextant.llm import merkle

WORDS = [f"w{k}" for k in range(300)] + ["one", "went", "it.", "so!"]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", "\n", "\n\n"]) for _ in range(n)).replace("\n ", "\n")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


class Tree:
    """The same tree, in loops."""

    def __init__(self, t):
        self.leaves, self.paragraphs, self.sections = set(), [], [[]]
        for p in t.split("\n"):
            nodes = []
            for piece in re.split("(?<=[ent.!?]) ", p):
                parts = [piece] if len(piece) <= 400 else re.split("(?<=[05afkqAFKQ/,\u3001\u3002\uff0c\u7684\u306e])", piece)
                own = [sha(x) + str(len(x)) for x in parts]
                self.leaves |= set(own)
                nodes.append(" +".join(own))
            self.paragraphs.append(sha(" ".join(nodes)))
        for k, node in enumerate(self.paragraphs):
            self.sections[-1].append(node)
            if (node[0] in "01" or node == sha(sha("") + "0")) and k + 1 < len(self.paragraphs):
                self.sections.append([])
        self.root = sha("".join(sha("".join(s)) for s in self.sections))


def like(a, b):
    weigh = lambda s: sum(int(x[64:]) + 1 for x in s)
    return 1.0 if a.root == b.root else min(weigh(a.leaves & b.leaves) / weigh(a.leaves | b.leaves), 0.999999)


def same_ends(a, b):
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    s = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    return p, min(s, min(len(a), len(b)) - p)


def descent(a, b):
    if a.root == b.root:
        return (None,) * 4
    p, s = same_ends(a.sections, b.sections)
    below, other = (sum(t.sections[p : len(t.sections) - s], []) for t in (a, b))
    q, r = same_ends(below, other)
    return p, len(a.sections) - p - s, sum(map(len, a.sections[:p])) + q, len(below) - q - r


TEXTS = [text(i, 10 + 7 * i) for i in range(30)]
ROWS = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 3000 + "0a" * 900), (104, "\u4e2d\u6587\u3002" * 700), (105, "na\u00efve \U0001f600 caf\u00e9\n" * 9), (7, "same"), (7, "same"), (7, "other"), (None, TEXTS[3]), (None, None), (106, text(99, 9000)), (2**62, "far"), (-(2**62), "low")]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("per_range", [512, 3])
def test_against_plain_trees(spark, monkeypatch, per_range):
    monkeypatch.setattr(merkle, "RANGE_DOCS", per_range)
    docs = spark.createDataFrame([(*r, 5, "x") for r in ROWS], "doc_id long, text string, root int, at string").repartition(5)
    rows = in_order(ROWS)
    want = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        a, b, c = Tree(t), Tree(edited), Tree(after)
        want.append((i, len(t), sha(edited), a.root, b.root, round(like(a, b), 9), round(like(a, c), 9), len(a.sections), len(a.paragraphs), *descent(a, b)))
    got = [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9), *r[7:]) for r in merkle.compare_with_edit(docs).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:5])
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x == y
    assert len({r[3] for r in got}) == len({t or "" for _, t in ROWS})


def test_edit_is_found(spark):
    lines = [text(k, 12).replace("\n", " ") for k in range(60)]
    changed = [*lines[:40], "another line", *lines[41:]]
    inserted = [*lines[:20], "one more", *lines[20:]]
    rows = [("\n".join(lines), "\n".join(x)) for x in (changed, inserted, lines)]
    df = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        df = df.withColumn(f"s{c}", merkle.sections(merkle.paragraph_nodes(merkle.leaf_nodes(F.col(c)))))
    got = [(r.first_paragraph, r.n_paragraphs) for r in merkle.edits(df, "sa", "sb").collect()]
    assert got == [(40, 1), (20, 0), (None, None)]


def test_likeness_follows_edits(spark):
    base = text(1, 400)
    r = random.Random(2)
    near = " ".join(w if r.random() > 0.01 else "Changed" for w in base.split(" "))
    blank = "".join(r.choice("0123456789abcdef") for _ in range(20000))
    rows = [(0, base), (1, near), (2, text(2, 400)), (3, base + " more"), (4, blank), (5, blank[:9000] + "zz" + blank[9002:])]
    got = {r.doc_id: r for r in merkle.compare_with_edit(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].near_next > 0.85 > 0.2 > got[1].near_next and 0.2 < got[2].near_edited < 0.8
    assert got[4].near_next > 0.9


def test_next_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_DOCS", 3)
    rows = [(i * i - 40, f"t{i}") for i in range(30)] + [(2**62, "far"), (-(10**12), "low")]
    got = {r.text: r.next_text for r in merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [t for _, t in sorted(rows)]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_empty_table(spark):
    assert merkle.compare_with_edit(spark.createDataFrame([], "doc_id long, text string")).count() == 0
