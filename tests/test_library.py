"""Text functions, queries, references, snapshots, evaluation and ledgers on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from sextant.functions import query as Q
from sextant.functions import text as T
from sextant.operators import dense, evaluate, flow, graph, judge, navigate, resolve
from sextant.operators import lexical as L
from sextant.plans import lexical as plans
from sextant.sources import snapshot
from sextant.streaming import ledger

IDENTS = {
    "getSessionFromCtx": "get session from ctx",
    "HTTPServer2": "http server2",
    "JWTs and userIDsByName": "jwts and user ids by name",
    "CSSStyle": "css style",
    "a/b-c.test.ts": "a b c test ts",
    "naïve café": "na ve caf",
    "Kelvin": "elvin",
    "": "",
}
STEMS = {"classes": "class", "policies": "policy", "status": "status", "boxes": "box", "pushes": "push", "files": "file", "ties": "tie", "ids": "ids", "cookies": "cooky", "access": "access"}


def test_identifiers_and_stems(spark):
    rows = spark.createDataFrame([(k,) for k in IDENTS], "x string").select("x", F.array_join(T.split_ident(F.col("x")), " ").alias("y")).collect()
    assert {r.x: r.y for r in rows} == IDENTS and all(" ".join(Q.split_ident(k)) == v for k, v in IDENTS.items())
    rows = spark.createDataFrame([(k,) for k in STEMS], "x string").select("x", T.stem(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == STEMS and all(Q.stem(k) == v for k, v in STEMS.items())


def test_query_terms():
    assert {"mint", "minted", "minting"} <= set(Q.variants("minting")) and "drop" in Q.variants("dropping") and "verify" in Q.variants("verified")
    assert "hop" not in Q.variants("hoping") and "cal" not in Q.variants("calling") and "cookie" in Q.variants("cookies")
    known = {"trpc", "rpc", "sign", "file"}
    got = Q.parse(known, "the tRPC signing of nowhere files", [("rpc", 0.5), ("ghost", 0.5)])
    assert [(t.label, t.variants) for t in got] == [("trpc", ("trpc",)), ("rpc", ("rpc",)), ("signing", ("sign",)), ("nowhere", ()), ("files", ("file",))]
    assert Q.topic("How does the index build work?") == "index build"


@pytest.fixture(scope="module")
def units(spark):
    rows = [("src/alpha/hub.ts", "hub of things", "hub hub body"), ("src/beta/other.ts", "nothing", "the hub is here\n" + "hub " * 200), ("doc/readme.md", None, None), ("src/alpha/more.ts", "hub", "thing")]
    return spark.createDataFrame(rows, "path string, sig string, body string")


def test_both_searches_agree(units):
    terms = [L.Term("hub", ("hub",)), L.Term("thing", ("thing", "things"), 0.5), L.Term("off", ("src",), 0.0)]
    for view in L.VIEWS:
        a = [tuple(r) for r in L.search(L.build(units), terms, view).select("path", "score", "matched", "rank").orderBy("rank").collect()]
        b = [tuple(r) for r in L.search_units(units, terms, view).select("path", "score", "matched", "rank").orderBy("rank").collect()]
        assert a == b
    assert L.search_units(units, terms, scope="src/alpha").count() == 2 and L.search_units(units, terms, scope="src/al").count() == 0
    assert L.cap(float("nan"), 3) == 0 and L.cap(2.9, 3) == 2 and L.cap(-1, 3) == 0 and L.cap(None, 3) == 3


def test_evidence(units):
    shown = {r.path: r.shown for r in L.evidence(units, [L.Term("hub", ("hub",))], {"hub": 2}, head=1, windows=1, radius=0).collect()}
    assert shown["src/beta/other.ts"] == ["1: the hub is here"] and shown["doc/readme.md"] in ([], None)


def test_references(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.ts", "a/b/index.ts", "a/b/y.js", "lib/pkg/src/main.ts", "py/m/__init__.py", "py/m/n.py", "src/top.py")], "path string")
    uses = [("a/b/y.js", "../x.js"), ("a/x.ts", "./b"), ("a/x.ts", "./b/y"), ("a/x.ts", "./none"), ("a/x.ts", "../../out"), ("a/x.ts", "@s/react/jsx"), ("a/x.ts", "pkg"), ("py/m/n.py", "."), ("py/m/n.py", ".n"), ("py/m/n.py", "top"), ("py/m/n.py", "os.path"), ("a/x.ts", "./x.ts?raw")]
    packages = spark.createDataFrame([("pkg", "lib/pkg", "src/main"), ("pkg", "lib/other/pkg", "z")], "pkg string, dir string, entry string")
    got = {(r["from"], r.spec): (r.kind, r.path, r.pkg) for r in resolve.resolve(files, spark.createDataFrame(uses, "from string, spec string"), packages).collect()}
    assert got[uses[0]] == ("file", "a/x.ts", None) and got[uses[1]] == ("file", "a/b/index.ts", None) and got[uses[2]] == ("file", "a/b/y.js", None)
    assert got[uses[3]][0] == got[uses[4]][0] == "unresolved" and got[uses[5]] == ("external", None, "@s/react")
    assert got[uses[6]] == ("file", "lib/pkg/src/main.ts", None) and got[uses[7]][1] == "py/m/__init__.py" and got[uses[8]][1] == "py/m/n.py"
    assert got[uses[9]][1] == "src/top.py" and got[uses[10]] == ("external", None, "os") and got[uses[11]][1] == "a/x.ts"


def test_chase(spark):
    r = [("a", "x", "b", "x", 0), ("a", "x", "c", "x", 1), ("b", "x", "d", "y", 0), ("l", "x", "m", "x", 0), ("m", "x", "l", "x", 0)]
    got = {x.file: (x.defined_in, x.defined_as, x.hops) for x in graph.chase(spark.createDataFrame([("a", "x"), ("l", "x"), ("z", "x")], "file string, name string"), spark.createDataFrame(r, "file string, name string, to string, to_name string, priority int")).collect()}
    assert got == {"a": ("d", "y", 2), "l": ("m", "x", 1), "z": ("z", "x", 0)}


def test_snapshot(spark, units, tmp_path):
    index = L.build(units)
    edges = spark.createDataFrame([("src/alpha/hub.ts", "src/beta/other.ts")], "from string, to string")
    snapshot.save(index, edges, str(tmp_path / "s"))
    again, _ = snapshot.load(spark, str(tmp_path / "s"))
    assert sorted(again.postings.collect()) == sorted(index.postings.collect())
    broken = {r.check: r.n for r in snapshot.integrity(L.Index(index.postings, index.doc_stats.where("path <> 'src/alpha/hub.ts'")), edges).collect()}
    assert broken["postings without a document"] > 0 and broken["edges without an end"] == 1


def test_files_and_patches(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"\0\0")
    got = {r.path: r.text for r in snapshot.read_files(spark, str(tmp_path)).collect()}
    assert got == {"d/a.txt": "one\ntwo\n", "b.bin": None}
    patch = 'diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\ndiff --git a/new b/new\nnew file mode 1\n--- /dev/null\n+++ b/new\ndiff --git a/o b/p\nrename from o\nrename to p\ndiff --git "a/\\303\\251" "b/\\303\\251"\n--- "a/\\303\\251"\n+++ "b/\\303\\251"\n'
    assert snapshot.patch_paths(patch) == ["x.py", "o", "é"]
    files = spark.createDataFrame([("t", "x.py"), ("t", "tests/test_x.py")], "task string, path string")
    assert [r.path for r in snapshot.relevant_paths(spark.createDataFrame([("t", patch)], "task string, patch string"), files).collect()] == ["x.py"]
    tasks, rel = snapshot.manifest(spark, json.dumps({"corpora": [{"id": "c", "tasks": [{"id": "t", "query": "q", "relevant": ["a", "b"]}]}]}))
    assert tasks.count() == 1 and rel.count() == 2


def test_metrics(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task string")
    runs = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "z", 1)], "task string, path string, rank int")
    rel = spark.createDataFrame([("a", "y"), ("a", "w"), ("b", "q")], "task string, path string")
    got = {r.task: r for r in evaluate.metrics(tasks, runs, rel).collect()}
    assert (got["a"].hit1, got["a"].hit5, got["a"].recall5, got["a"].mrr10) == (0, 1, 0.5, 0.5) and got["b"].ndcg10 == got["c"].ndcg10 == 0.0
    flows = spark.createDataFrame([("f", ["a", "b"], ["a", "c"], [], ["b"], [["b", "a"]], [["a", "b"]], [["a", "b"]])], "id string, nodes array<string>, must array<string>, should array<string>, must_not array<string>, edges array<array<string>>, must_edges array<array<string>>, known_edges array<array<string>>")
    assert tuple(evaluate.flow_score(flows).first())[1:] == (0.5, 1.0, 1, 1.0, 0)


def test_judges_and_walk(spark):
    rows = spark.createDataFrame([("u", "alpha beta"), ("v", "none")], "unit string, text string")
    assert {r.unit: r.belief for r in judge.Overlap(["alpha", "beta"]).score(rows, "member").collect()} == {"u": 1.0, "v": 0.0}
    record = spark.createDataFrame([("member", "v", 0.4)], "stage string, unit string, belief double")
    assert {r.unit: r.belief for r in judge.Replay(record).score(rows, "member").collect()} == {"u": 0.0, "v": 0.4}
    children = spark.createDataFrame([("", "a", "dir", 0.6, 1.0), ("", "b", "dir", 0.4, 1.0), ("a", "a/x", "file", 0.5, 0.05), ("b", "b/y", "file", 0.9, 0.9)], "parent string, path string, kind string, p double, under double")
    assert [(r.path, r.score) for r in navigate.walk(children).collect()] == [("b/y", 0.6)]
    assert navigate.strategy("How does it work") == "explain" and navigate.strategy("where", "map") == "map" and navigate.clean_params(99, float("nan"), "/a/") == (10, 12, "a")


def test_reading_order():
    nodes = [{"path": p, "role": r} for p, r in (("s", "service"), ("u", "ui"), ("c", "service"), ("q", "odd"))]
    assert flow.reading_order(nodes, [("u", "s"), ("s", "c"), ("c", "s")])[0] == "u" and flow.reading_order(nodes, [])[-1] == "q"


def test_windows_of_tokens(spark):
    n = spark.range(1).select(dense.token_windows(F.sequence(F.lit(1), F.lit(500)).cast("array<string>")).alias("w")).first().w
    assert len(n) == 3 and n[0][-1] == "192" and n[1][0] == "161" and n[-1][-1] == "500"


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i // 9}:0{i % 9}", str(i % 2)) for i in range(27)]
    df = spark.createDataFrame(rows, "id long, ts string, identity string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ledger.stream_minutes(stream, "1 second").writeStream.format("memory").queryName("minutes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(str(r.minute), r.identity): r.n for r in spark.table("minutes").collect()}
    want = {(str(r.minute), r.identity): r.n for r in ledger.minute_counts(df).collect()}
    assert got and got.items() <= want.items()
    first = {r.id: r.decision for r in ledger.admissions(df, 3, 5).collect()}
    assert sum(d == "admitted" for d in first.values()) == 15


def test_rows_of_strategies(spark):
    rows = [("a", "find", ["x", "y"], ["y"]), ("b", "find", [], []), ("c", "walk", ["z"], [])]
    got = {r.task: (r.hit1, r.hit10) for r in evaluate.score_rows(spark.createDataFrame(rows, "task string, strategy string, ranked array<string>, accept array<string>")).collect()}
    assert got == {"a": (0, 1), "b": (1, 1), "c": (0, 0)}
    lost = evaluate.loss_histogram(spark.createDataFrame([("find", "rank"), ("find", "rank"), ("walk", "unseen")], "strategy string, stage string")).collect()
    assert {r.strategy: r.lost for r in lost} == {"find": {"rank": 2}, "walk": {"unseen": 1}}
    trace = spark.createDataFrame([("a", "pool", "x", 2.0), ("a", "pool", "y", 1.0), ("a", "verify", "x", 1.0)], "task string, stage string, path string, score double")
    ranks = evaluate.stage_ranks(trace, spark.createDataFrame([("a", "y")], "task string, path string")).collect()
    assert {r.stage: r["rank"] for r in ranks} == {"pool": 2, "verify": None}


def test_evidence_weighs_by_counted_documents(spark, tmp_path):
    """Here "thing" is rarer than "hand", so its line comes before the third line of "hand"."""
    body = "\n".join(["head"] * 8 + ["x"] * 5 + ["a hand"] + ["x"] * 9 + ["my hand"] + ["x"] * 9 + ["one hand"] + ["x"] * 9 + ["things"] + ["x"] * 9)
    rows = [(0, body, "en", "s"), (1, "hand", "en", "s"), (2, "a hand", "en", "s"), (3, "nothing", "en", "s"), (4, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r.shown.split("\n") for r in plans.evidence_windows(spark, str(tmp_path)).collect()}["en/s/doc_0.txt"]
    assert any(x.endswith(": things") for x in got) and not any(x.endswith(": one hand") for x in got)
    assert L.unit_df(plans.units(spark, str(tmp_path)), plans.TERMS[:3]) == {"hand": 3, "thing": 1, "ention": 0}
