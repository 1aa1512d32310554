"""References through settings of projects, barrels, crates and submodules."""

from sextant.api import Library
from sextant.operators import projects

FILES = {
    "package.json": '{"name": "root", "imports": {"#db": "./src/db.ts", "#env/*": {"types": "./src/env/*.ts"}, "#ext": "left-pad", "#kit": "@acme/kit"}}',
    "tsconfig.json": '{ // settings\n "extends": "./base.json", "compilerOptions": {"paths": {"@app/*": ["src/app/*", "src/*"], "@app/exact": ["src/db.ts"], "~*": ["gen/*"]},} }',
    "base.json": '{"compilerOptions": {"baseUrl": "."}}',
    "src/db.ts": "export const db = 1;", "src/env/prod.ts": "export const p = 1;", "src/app/home.ts": "export const home = 1;", "src/index.ts": "",
    "pkgs/kit/package.json": '{"name": "@acme/kit", "exports": {".": {"import": "./dist/main.js"}, "./ui/*": "./dist/ui/*.js"}}',
    "pkgs/kit/tsconfig.json": '{"compilerOptions": {"outDir": "dist", "rootDir": "source"}}',
    "pkgs/kit/source/main.ts": "", "pkgs/kit/source/ui/card.tsx": "", "pkgs/kit/extra.ts": "",
    "pkgs/old/package.json": '{"name": "old", "main": "lib/start.js"}', "pkgs/old/src/start.ts": "", "pkgs/old/tool.js": "",
    "crate/src/lib.rs": "", "crate/src/a.rs": "", "crate/src/net/mod.rs": "", "crate/src/net/tcp.rs": "",
}

WANT = {
    ("src/index.ts", "@app/home"): ("file", "src/app/home.ts", None), ("src/index.ts", "@app/db"): ("file", "src/db.ts", None), ("src/index.ts", "@app/exact"): ("file", "src/db.ts", None), ("src/index.ts", "@app/none"): ("unresolved", None, None),
    ("src/index.ts", "src/env/prod"): ("file", "src/env/prod.ts", None), ("src/index.ts", "#db"): ("file", "src/db.ts", None), ("src/index.ts", "#env/prod"): ("file", "src/env/prod.ts", None), ("src/index.ts", "#gone"): ("unresolved", None, None),
    ("src/index.ts", "#ext"): ("external", None, "left-pad"), ("src/index.ts", "#kit"): ("file", "pkgs/kit/source/main.ts", None), ("src/index.ts", "@acme/kit"): ("file", "pkgs/kit/source/main.ts", None),
    ("src/index.ts", "@acme/kit/ui/card"): ("file", "pkgs/kit/source/ui/card.tsx", None), ("src/index.ts", "@acme/kit/extra"): ("file", "pkgs/kit/extra.ts", None), ("src/index.ts", "@acme/kit/no"): ("unresolved", None, None),
    ("src/index.ts", "old"): ("file", "pkgs/old/src/start.ts", None), ("src/index.ts", "old/tool"): ("file", "pkgs/old/tool.js", None), ("src/index.ts", "react/jsx"): ("external", None, "react"), ("src/index.ts", "fs/promises"): ("external", None, "node:fs"),
    ("src/index.ts", "node:path/posix"): ("external", None, "node:path"), ("src/index.ts", "./db"): ("file", "src/db.ts", None), ("pkgs/old/tool.js", "@app/home"): ("file", "src/app/home.ts", None),
    ("crate/src/lib.rs", "a"): ("file", "crate/src/a.rs", None), ("crate/src/net/tcp.rs", "super"): ("file", "crate/src/net/mod.rs", None), ("crate/src/net/tcp.rs", "crate::a"): ("file", "crate/src/a.rs", None),
    ("crate/src/net/mod.rs", "self::tcp"): ("file", "crate/src/net/tcp.rs", None), ("crate/src/net/mod.rs", "super::gone"): ("unresolved", None, None), ("crate/src/lib.rs", "serde::de"): ("external", None, "serde"),
}


def test_resolve_all(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    uses = spark.createDataFrame(list(WANT), "from string, spec string")
    got = {(r["from"], r.spec): (r.kind, r.path, r.pkg) for r in projects.resolve_all(files, uses).collect()}
    assert {k: v for k, v in got.items() if v != WANT[k]} == {} and len(got) == len(WANT)


def test_settings():
    own = projects.Settings({"a/tsconfig.json": '{"extends": ["./x", "./y.json"]}', "a/x.json": '{"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "p"}}', "a/y.json": '{"compilerOptions": {"baseUrl": "../../out", "outDir": "o"}}', "b.json": "[1", "c.json": None})
    assert own.options("a/tsconfig.json") == {"base": "a/p", "out": "a/o"} and own.options("none") == {}
    assert projects.parsed('{"a": "// no", /* x */ "b": [1, 2,],}') == {"a": "// no", "b": [1, 2]} and projects.joined("a", "../..") is None


def test_barrels_and_submodules(spark):
    files = {
        "a/index.ts": 'export { one } from "./one";\nexport * from "./two";\n', "a/one.ts": "export const one = 1;", "a/two.ts": 'export const two = 2;\nexport { three } from "../three";', "three.ts": "export const three = 3;",
        "main.ts": 'import { one, two } from "./a";\nimport { three } from "./a";\nimport { other } from "./a";\n',
        "p/__init__.py": "def shown(): pass\n", "p/sub.py": "x = 1\n", "p/deep/__init__.py": "", "use.py": "from p import sub, shown\nfrom p import deep\n",
    }
    edges = {(r["from"], r["to"]): (sorted(r.names), r.via) for r in Library(spark.createDataFrame(list(files.items()), "path string, text string")).edges.collect()}
    assert edges["main.ts", "a/one.ts"] == (["one"], "a/index.ts") and edges["main.ts", "a/two.ts"] == (["two"], "a/index.ts") and edges["main.ts", "three.ts"] == (["three"], "a/index.ts")
    assert edges["main.ts", "a/index.ts"] == (["other"], None) and ("a/index.ts", "a/one.ts") in edges
    assert edges["use.py", "p/sub.py"] == (["sub"], None) and edges["use.py", "p/__init__.py"] == (["shown"], None) and edges["use.py", "p/deep/__init__.py"] == (["deep"], None)


def test_equal_references_are_matched_once(spark, monkeypatch):
    seen, matched = [], projects._matched
    monkeypatch.setattr(projects, "_matched", lambda uses, *rest: seen.append(uses) or matched(uses, *rest))
    texts = {"a/tsconfig.json": '{"compilerOptions": {"paths": {"@m/*": ["src/*"]}}}', "p/package.json": '{"name": "p", "exports": {"./*": "./dist/*.js"}}', "a/src/x.ts": "", "p/src/y.ts": ""}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    uses = spark.createDataFrame([(f"a/n{i}.ts", s) for i in range(40) for s in ("@m/x", "p/y", "q/z")], "from string, spec string")
    got = projects.resolve_all(files, uses).collect()
    assert {(r.spec, r.kind, r.path, r.pkg) for r in got} == {("@m/x", "file", "a/src/x.ts", None), ("p/y", "file", "p/src/y.ts", None), ("q/z", "external", None, "q")}
    assert len(got) == 120 and max(u.count() for u in seen) == 3
