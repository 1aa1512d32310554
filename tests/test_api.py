"""The verbs over a small tree of source files."""

import pytest

from sextant.api import Library

FILES = {
    "src/auth/session.ts": '// Keeps a session of a user.\nimport { sign } from "./token";\nexport function openSession() { return sign("user"); }\n',
    "src/auth/token.ts": "// Signs a session token.\nexport function sign(x: string) { return hash(x); }\n",
    "src/web/page.ts": 'import { openSession } from "../auth/session";\nimport react from "react";\nimport gone from "./gone";\nexport const page = openSession();\n',
    "docs/readme.md": "# Guide\n\nHow to run it.\n",
}


@pytest.fixture(scope="module")
def library(spark):
    return Library(spark.createDataFrame(list(FILES.items()), "path string, text string"))


def test_find(library):
    got = library.find("session token")
    assert got.verdict == "found" and {r["path"] for r in got.rows[:2]} == {"src/auth/token.ts", "src/auth/session.ts"}
    assert library.find("zebra").verdict == "absent"


def test_map_and_edges(library):
    got = library.map("session")
    assert {r["path"] for r in got.rows} == {"src/auth/session.ts", "src/auth/token.ts", "src/web/page.ts"} and got.stats["heat"]["src/auth"] == 1.0
    assert {(r["from"], r["to"]) for r in library.edges.collect()} == {("src/auth/session.ts", "src/auth/token.ts"), ("src/web/page.ts", "src/auth/session.ts")}
    assert {r.kind for r in library.resolved.where("spec in ('react', './gone')").collect()} == {"external", "unresolved"}


def test_explain_and_coverage(spark, library):
    got = library.explain("How does session work?")
    assert [r["path"] for r in got.rows] and set(got.stats["edges"]) == {("src/auth/session.ts", "src/auth/token.ts"), ("src/web/page.ts", "src/auth/session.ts")} and got.verdict == "found"
    row = library.coverage(spark.createDataFrame([("src/web/page.ts",)], "node string")).first()
    assert (row.nodes, row.examined, row.frontier, row.unresolved, row.unexamined) == (4, 1, 1, 1, 3)


def test_signatures(library):
    from sextant.operators import signature

    got = {r.path: r for r in library.signatures.collect()}
    assert got["src/auth/token.ts"].exports == ["sign"] and got["src/auth/session.ts"].local == ["token"] and got["src/web/page.ts"].imports[0].spec == "react" and got["docs/readme.md"].exports is None
    assert signature.descriptors(library.signatures).count() == 4
    small = signature.fill("p", {"exports": ["x" * 30, "y"], "calls": ["z"]}, "A long story about nothing at all", 60)
    assert small.get("exports") == ["y"] or "about" in small
