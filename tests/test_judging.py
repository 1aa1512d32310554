"""Admission ladder, comment blocks, stages, spine and batteries on small tables."""

import datetime as dt

import pytest

from sextant.operators import flow, judge
from sextant.streaming import ledger


def test_ladder(spark):
    t = dt.datetime(2024, 1, 1, 12, 0, 0)
    at = lambda s: t + dt.timedelta(seconds=s)
    rows = [
        (1, at(0), "a", "q1", False, 30.0), (2, at(1), "b", "q1", False, 5.0), (3, at(2), "b", "q2", False, 5.0), (4, at(3), "b", "q3", False, 5.0), (5, at(4), "c", "q9", True, 1.0),
        (6, at(10), "c", "q4", False, 300.0), (7, at(31), "d", "q5", False, 1.0), (8, at(46), "e", "q2", False, 1.0),
    ]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, identity string, key string, cached boolean, seconds double")
    got = {r.id: (r.decision, r.retry_after) for r in ledger.ladder(df).collect()}
    assert got[1] == ("active", 0) and got[2] == ("same", 3) and got[3] == ("queued", 0) and got[4] == ("own", 3) and got[5] == ("cached", 0)
    assert got[6] == ("queued", 0)  # waits with q2; q2's wait is over at 17, before q1 ends at 30, and q4's at 25
    assert got[7] == ("active", 0) and got[8] == ("active", 0)
    flood = spark.createDataFrame([(k, at(k / 100), "z", f"k{k}", True, 1.0) for k in range(9)], df.schema)
    assert sorted(r.decision for r in ledger.ladder(flood).collect()) == ["cached"] * 6 + ["minute"] * 3
    crowd = spark.createDataFrame([(k, at(k / 100), f"u{k}", f"k{k}", False, 80.0) for k in range(12)], df.schema)
    assert sorted(r.decision for r in ledger.ladder(crowd).collect()) == ["active"] + ["full"] * 3 + ["queued"] * 8


def test_parameters():
    assert ledger.only_params([("q", "x")], ("q", "scope")) == {"q": "x"}
    for bad in ([("x", "1")], [("q", "1"), ("q", "2")]):
        with pytest.raises(ValueError):
            ledger.only_params(bad, ("q",))
    assert judge.recoverable(429) and judge.recoverable(503) and judge.recoverable(None, True) and not judge.recoverable(404) and not judge.recoverable(None)


def test_stages_and_spine():
    nodes, edges = list("abcde"), [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("x", "a")]
    assert flow.stages(nodes, edges) == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0}
    assert flow.spine({"a": 0.9, "b": 0.2, "c": 0.8, "d": 0.7, "e": 1.0}, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "d", 1.0), ("d", "c", 0.5)]) == ["a", "d", "c"]
    assert flow.spine({}, []) == [] and flow.stages([], []) == {}


def test_comment_blocks(spark):
    js = "#!/bin/x\n/** Reads\n * things.\n */\nfunction f() {}\n// ----\n// one\nlet x = 1; // tail\n\n/* open"
    df = spark.createDataFrame([("a/b.ts", js), ("q.sql", "-- counts\nselect 1"), ("n.txt", "plain"), ("e.py", "")], "path string, body string")
    got = sorted((r.path, r.line, list(r.text)) for r in flow.comment_blocks(df).collect())
    assert got == [("a/b.ts", 2, ["Reads", "things.", "→ function f() {}"]), ("a/b.ts", 7, ["one", "→ let x = 1; // tail"]), ("a/b.ts", 10, ["open"]), ("q.sql", 1, ["counts", "→ select 1"])]


def test_judge_of_calls(spark):
    import json

    rows = spark.createDataFrame([(f"u{k:03}", "good text" if k % 3 else "bad") for k in range(200)], "unit string, text string")

    def ask(state):
        entries = [json.loads(e) for e in json.loads(state)["entries"]]
        assert len(entries) <= 60 and json.loads(state)["query"] == "what"
        return [1.0 if "good" in e["text"] else 0.25 for e in entries]

    got = {r.unit: r.belief for r in judge.Calls(ask, "what").score(rows, "shortlist").collect()}
    assert got == {f"u{k:03}": 1.0 if k % 3 else 0.25 for k in range(200)}
    for bad in (lambda s: [2.0] * 60, lambda s: []):
        with pytest.raises(ValueError):
            judge.Calls(bad, "what").score(rows, "shortlist")
