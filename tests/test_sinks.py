"""Results and sources written, streamed and read again."""

import gzip
import json

import pytest

from sextant.api import Library, Result
from sextant.functions.facts import facts_of
from sextant.sources import sinks


def test_page_holds_its_data():
    got = sinks.page("a <b>", Result([{"path": "</script><b>\u2028"}], "found"))
    assert got.count("</script>") == 1 and "a &lt;b&gt;" in got
    data = got.split("const data = ")[1].split(";\n")[0]
    assert json.loads(data)["rows"][0]["path"] == "</script><b>\u2028" and json.loads(sinks.as_json(Result([], "absent")))["verdict"] == "absent"


def test_stream_of_frames(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"run": 1, "seq": 2, "type": "done", "payload": "{}"}\n{"run": 1, "seq": 1, "type": "start", "payload": null}\n')
    got = []
    query = sinks.stream_frames(spark.readStream.schema("run long, seq long, type string, payload string").json(f"file://{folder}"), got.append, f"file://{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    assert got == ['event: start\ndata: {"type":"start","payload":null}\n\n', 'event: done\ndata: {"type":"done","payload":{}}\n\n']


def test_exports_and_sets(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "x"), ("b.py", None)], "path string, text string")
    sinks.export_corpus(files, spark.createDataFrame([("q", "what")], "query string, text string"), f"file://{tmp_path}/out")
    sent = {r.path: r.hash for r in spark.read.json(f"file://{tmp_path}/out/files").collect()}
    (tmp_path / "v.json").write_text("\n".join(json.dumps({"path": p, "hash": h, "vector": [1.0]}) for p, h in sent.items()))
    assert {r.path for r in sinks.import_vectors(spark, f"file://{tmp_path}/v.json", files).collect()} == {"a.py", "b.py"}
    with pytest.raises(Exception, match="another text"):
        sinks.import_vectors(spark, f"file://{tmp_path}/v.json", files.withColumn("text", files.path)).collect()
    root = {"python": [{"repo": "o/r", "content": {"m.py": "def f(): pass"}, "needles": [{"name": "f", "path": "m.py", "description": "does f"}]}]}
    with gzip.open(tmp_path / "set.json.gz", "wt") as f:
        json.dump(root, f)
    got, tasks = sinks.prepare(spark, f"file://{tmp_path}/set.json.gz")
    assert [tuple(r) for r in got.collect()] == [("python/o/r", "m.py", "def f(): pass")] and tasks.first().relevant == ["m.py"]
    sinks.write_shards(files, f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == 2 and sinks.catalogue(spark).count() == 5
    sinks.persist(files, files.limit(1), f"file://{tmp_path}/run")
    assert spark.read.json(f"file://{tmp_path}/run/rows").count() == 2


def test_library_saved_and_walked(spark, tmp_path):
    files = spark.createDataFrame([("a/clock.ts", 'import { tick } from "./tick";\nexport function clock() { return tick(); }'), ("a/tick.ts", "export const tick = () => 1;"), ("b/other.md", "# Nothing")], "path string, text string")
    library = Library(files)
    library.save(f"file://{tmp_path}/snap")
    again = Library.load(files, f"file://{tmp_path}/snap")
    assert {(r["from"], r["to"]) for r in again.edges.collect()} == {("a/clock.ts", "a/tick.ts")}
    assert again.find("clock tick").rows[0]["path"] == library.find("clock tick").rows[0]["path"] == "a/clock.ts"
    assert again.run_find("clock tick", walk_only=True).rows[0]["path"] == "a/clock.ts"


def test_more_facts():
    js = facts_of('import d, { a as b, type C } from "x";\nconst { e, f: g } = require("y");\nfunction h() {}\nexport { h, b as k };\nmodule.exports = { h, m };\nexports.n = 1;\nexport default {};', ".js")
    assert [(i[0], i[1]) for i in js.imports] == [("x", ["d", "a", "C"]), ("y", ["e", "f"])]
    assert {(d[0], d[2]) for d in js.decls} >= {("h", True), ("k", True), ("m", True), ("n", True), ("default", True)}
    rs = facts_of("use a::{b::{C, D as E}, f::*, self};\nmod inner;\npub use crate::g::H;", ".rs")
    assert [(i[0], i[1], i[2]) for i in rs.imports] == [("a::b", ["C", "D"], "import"), ("a::f", ["*"], "import"), ("a", [], "import"), ("self::inner", [], "import"), ("crate::g", ["H"], "reexport")]
    assert facts_of("type T { id: ID! others(n: Int): [T] }\ninput I { x: Int }", ".graphql").keys == ["T.id", "T.others", "I.x"]
    assert facts_of("@Entity\npublic class A { @Inject B b; @Override void f() {} }", ".java").calls[-2:] == ["Entity", "Inject"]
    assert "app.route" in facts_of("@app.route('/x')\ndef f(): pass", ".py").calls
