"""Settings of projects that redirect references: path patterns and base folders, package maps, built output, crates, submodules.

The settings' files are few, so they are read on the driver, into a table of rules: in a scope, a pattern leads to a target, in an
order. References meet the rules of their scope by an equi-join, the best pattern of a lane counts, and its targets become probe paths
that one join with the files decides, as for other references.
"""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import resolve as R

# Fixed values.
CONDITIONS = ("types", "import", "module", "default", "require", "node")
OUTPUT, SOURCE = ("dist", "build", "lib", "out"), ("src", "")
BUILT = re.compile(r"(\.d)?\.[cm]?[jt]sx?$")
DEEPEST, MOST_SETTINGS = 4, 50_000
#: Modules of the runtime itself.
BUILTIN = frozenset("assert async_hooks buffer child_process cluster console crypto dgram dns events fs http http2 https module net os path perf_hooks process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split())

RULE = "lane int, scope string, head string, tail string, star boolean, rank int, place int, target string"
LANES = {"paths": 0, "base": 1, "imports": 2, "package": 3, "folder": 4}


def parsed(text: str | None) -> dict:
    """An object of JSON with comments and trailing commas; anything else is an empty one."""
    if not text:
        return {}
    bare = re.sub(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text.removeprefix("﻿"), flags=re.S)
    bare = re.sub(r'("(?:[^"\\\n]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)
    try:
        got = json.loads(bare)
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def joined(folder: str, path: str) -> str | None:
    """A path from a folder, without . and ..; None where it leaves the root."""
    out = posixpath.normpath(posixpath.join(folder, path)) if path or folder else ""
    return None if out == ".." or out.startswith("../") or out.startswith("/") else "" if out == "." else out


def _strings(value: object) -> list[str]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str)]


class Settings:
    """All settings' files by path."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.json = {p: parsed(t) for p, t in texts.items()}
        self.packages: dict[str, str] = {}  # name -> path of its package.json, the shallowest of a name
        for p in sorted((p for p in self.json if posixpath.basename(p) == "package.json"), key=lambda p: (len(p), p)):
            if isinstance(name := self.json[p].get("name"), str) and name:
                self.packages.setdefault(name, p)

    def parent(self, folder: str, name: str) -> str | None:
        """The file that ``extends`` names: from the folder, or in a package that is here."""
        if name.startswith("."):
            base = joined(folder, name)
        else:
            m = re.match(r"((?:@[^/]+/)?[^/]+)/?(.*)$", name)
            home = self.packages.get(m[1]) if m else None
            base = joined(posixpath.dirname(home), m[2] or "tsconfig.json") if home else None
        return next((p for p in (base, f"{base}.json", f"{base}/tsconfig.json") if p in self.json), None) if base is not None else None

    def options(self, path: str, depth: int = 0, seen: frozenset = frozenset()) -> dict:
        """base, out, root and paths of a config over those of what it extends; later ones of several win."""
        if path in seen or path not in self.json:
            return {}
        own, folder, out = self.json[path], posixpath.dirname(path), {}
        if depth < DEEPEST:
            for name in _strings(own.get("extends")):
                if above := self.parent(folder, name):
                    out |= self.options(above, depth + 1, seen | {path})
        compiler = own.get("compilerOptions") if isinstance(own.get("compilerOptions"), dict) else {}
        for key, option in (("base", "baseUrl"), ("out", "outDir"), ("root", "rootDir")):
            if isinstance(compiler.get(option), str) and (at := joined(folder, compiler[option])) is not None:
                out[key] = at
        if isinstance(compiler.get("paths"), dict):
            start = out.get("base", folder)
            out["paths"] = {k: [t for x in _strings(v) if (t := joined(start, x)) is not None] for k, v in compiler["paths"].items()}
        return out

    def sources(self, folder: str, target: str) -> list[str]:
        """What a built file of a package may be compiled from: the output folder turned into the source's. An output folder itself is its index."""
        options = self.options(joined(folder, "tsconfig.json") or "")
        bare = BUILT.sub("", target)
        outs = [options.get("out"), *[joined(folder, x) for x in OUTPUT]]
        roots = [options.get("root"), *[joined(folder, x) for x in SOURCE]]
        found = []
        for o in dict.fromkeys(x for x in outs if x):
            if bare == o or bare.startswith(o + "/"):
                found += [posixpath.join(r, bare[len(o) + 1 :] or "index") for r in dict.fromkeys(x for x in roots if x is not None)]
        return found

    def conditions(self, value: object) -> list[str]:
        """Every path that a value of a map could mean, the preferred condition first."""
        if isinstance(value, str):
            return [value]
        if isinstance(value, list):
            return [x for v in value for x in self.conditions(v)]
        if isinstance(value, dict):
            place = {c: i for i, c in enumerate(CONDITIONS)}
            return [x for k in sorted(value, key=lambda k: place.get(k, len(place))) for x in self.conditions(value[k])]
        return []

    def rules(self) -> list[tuple]:
        """Rows of RULE."""
        out: list[tuple] = []

        def add(lane: str, scope: str, pattern: str, targets: list[str]) -> None:
            head, star, tail = pattern.partition("*")
            for i, t in enumerate(dict.fromkeys(targets)):
                out.append((LANES[lane], scope, head, tail, bool(star), len(head) if star else 1 << 20, i, t))

        def places(folder: str, targets: list[str]) -> list[str]:
            direct = [p for t in targets if (p := joined(folder, t)) is not None]
            return direct + [s for p in direct for s in self.sources(folder, p)]

        for path in self.json:
            if posixpath.basename(path) in ("tsconfig.json", "jsconfig.json"):
                own = self.options(path)
                for pattern, targets in own.get("paths", {}).items():
                    add("paths", path, pattern, targets)
                if "base" in own:
                    add("base", path, "*", [posixpath.join(own["base"], "*")])
            if posixpath.basename(path) == "package.json":
                folder = posixpath.dirname(path)
                for pattern, value in (self.json[path].get("imports") or {}).items() if isinstance(self.json[path].get("imports"), dict) else ():
                    targets = self.conditions(value)
                    inside = [t for t in targets if t.startswith(".")]
                    add("imports", path, pattern, places(folder, inside) + [f"package:{t}" for t in targets if not t.startswith((".", "#"))][:1])
        for name, path in self.packages.items():
            own, folder = self.json[path], posixpath.dirname(path)
            exports = own.get("exports")
            if exports is None:
                add("package", name, name, places(folder, _strings([own.get(k) for k in ("types", "typings", "module", "main")])))
                add("package", name, f"{name}/*", places(folder, ["./*"]))
            else:
                if not (isinstance(exports, dict) and any(k.startswith(".") for k in exports)):
                    exports = {".": exports}
                for key, value in exports.items():
                    add("package", name, name + key[1:], places(folder, self.conditions(value)))
            add("folder", name, name, [joined(folder, "index") or "index"])
            add("folder", name, f"{name}/*", [posixpath.join(folder, "*")])
        return out


def settings(files: DataFrame) -> Settings:
    """Reads the settings among ``files`` (path, text): package.json and JSON with compiler options. More than MOST_SETTINGS are an error."""
    name = T.base_name(F.col("path"))
    own = files.where((name == "package.json") | name.rlike(r"^(ts|js)config(\..*)?\.json$") | (name.endswith(".json") & F.col("text").contains("compilerOptions"))).where("text is not null").select("path", "text")
    rows = own.limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError(f"over {MOST_SETTINGS} settings' files")
    return Settings({r.path: r.text for r in rows})


def rule_table(spark: SparkSession, own: Settings) -> DataFrame:
    return spark.createDataFrame(own.rules(), RULE)


def nearest(dirs: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """(dir, ``name``): the deepest mark at or above each folder. ``marks``: at (a folder), mark."""
    here = F.array_distinct(F.concat(F.array(F.lit("")), T.ancestors(F.concat("dir", F.lit("/x")))))
    each = dirs.select("dir", F.explode(here).alias("at")).join(marks, "at")
    return each.groupBy("dir").agg(F.max_by("mark", F.struct(F.length("at"), "mark")).alias(name))


def _scoped(uses: DataFrame, rules: DataFrame) -> DataFrame:
    """Scopes of each use: the nearest config and package.json, and the package that it names."""
    dirs = uses.select("dir").distinct()
    of = lambda lane: rules.where(F.col("lane").isin(*lane)).select("scope").distinct().select(T.dir_of(F.col("scope")).alias("at"), F.col("scope").alias("mark"))
    configs, manifests = nearest(dirs, of((0, 1)), "config"), nearest(dirs, of((2,)), "manifest")
    return uses.join(configs, "dir", "left").join(manifests, "dir", "left")


def _matched(uses: DataFrame, rules: DataFrame, lanes: tuple[int, ...], scope: Column) -> DataFrame:
    """(id, spec, lane, place, target, catch_all): targets of the best pattern of each lane, the star's part filled in."""
    own = rules.where(F.col("lane").isin(*lanes))
    rows = uses.select("id", "spec", scope.alias("scope")).join(own, "scope")
    fits = F.when(F.col("star"), F.col("spec").startswith(F.col("head")) & F.col("spec").endswith(F.col("tail")) & (F.length("spec") >= F.length("head") + F.length("tail"))).otherwise(F.col("spec") == F.col("head"))
    rows = rows.where(fits)
    best = F.max("rank").over(Window.partitionBy("id", "lane"))
    rows = rows.withColumn("best", best).where(F.col("rank") == F.col("best"))
    part = F.substring("spec", F.length("head") + 1, F.length("spec") - F.length("head") - F.length("tail"))
    target = F.when(F.col("star"), F.replace("target", F.lit("*"), part)).otherwise(F.col("target"))
    return rows.select("id", "spec", "lane", "place", target.alias("target"), (F.col("star") & (F.col("head") == "") & (F.col("tail") == "")).alias("catch_all"))


def package_of(spec: Column) -> Column:
    return F.regexp_extract(spec, r"(?i)^((?:@[a-z0-9][\w.-]*/)?[a-z0-9][\w.-]*)(?:/.*)?$", 1)


def resolve_bare(files: DataFrame, uses: DataFrame, rules: DataFrame) -> DataFrame:
    """(from, spec, kind, path, pkg) of references by name: path patterns, then the base folder, then a package's own # names or a
    package that is here; what no rule knows is external. ``files``: path."""
    rows = _scoped(uses.select("from", "spec").distinct().withColumn("dir", T.dir_of(F.col("from"))), rules)
    rows = rows.withColumn("id", F.xxhash64(*[F.coalesce(c, F.lit("")) for c in ("config", "manifest", "spec")]))
    # Rules see the scopes and the spec alone: these are matched and probed once, however many files ask.
    asks = rows.select("id", "spec", "config", "manifest").distinct()
    hashed = F.col("spec").startswith("#")
    by_config = _matched(asks, rules, (0, 1), F.col("config"))
    by_name = _matched(asks.where(hashed), rules, (2,), F.col("manifest"))
    outward = by_name.where(F.col("target").startswith("package:")).select("id", F.substring("target", 9, 10_000).alias("spec"))
    packages = asks.where(~hashed).select("id", "spec").unionByName(outward)
    by_package = _matched(packages, rules, (3, 4), package_of(F.col("spec")))
    found = by_config.unionByName(by_name.where(~F.col("target").startswith("package:"))).unionByName(by_package)
    probed = found.select("id", "lane", "place", F.posexplode(R.probes(F.col("target"), F.lit(False))).alias("try", "path")).where("path is not null")
    hit = probed.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", F.struct("lane", "place", "try")).alias("path"))
    ruled = by_config.where("lane = 0 and not catch_all").select("id").distinct().withColumn("ruled", F.lit(True))
    named = rules.where("lane = 3").select(F.col("scope").alias("pkg")).distinct().withColumn("here", F.lit(True))
    away = outward.groupBy("id").agg(F.first("spec").alias("away"))
    out = asks.join(hit, "id", "left").join(ruled, "id", "left").join(away, "id", "left").withColumn("asked", F.coalesce("away", "spec")).withColumn("pkg", package_of(F.col("asked"))).join(F.broadcast(named), "pkg", "left")
    scheme = F.col("asked").rlike("(?i)^[a-z][a-z0-9+.-]*:")
    known = F.coalesce("ruled", F.lit(False)) | F.coalesce("here", F.lit(False)) | (hashed & F.col("away").isNull())
    kind = F.when(F.col("path").isNotNull(), "file").when(known, "unresolved").when(scheme | (F.col("pkg") != ""), "external").otherwise("unresolved")
    name = F.when(scheme, F.when(F.col("asked").startswith("node:"), F.regexp_extract("asked", "^([^/]*)", 1)).otherwise(F.col("asked"))).when(F.col("pkg").isin(*sorted(BUILTIN)), F.concat(F.lit("node:"), "pkg")).otherwise(F.col("pkg"))
    answers = out.select("id", kind.alias("kind"), "path", F.when(kind == "external", name).alias("pkg"))
    return rows.select("from", "spec", "id").join(answers, "id", "left").select("from", "spec", "kind", "path", "pkg")


def resolve_rust(files: DataFrame, uses: DataFrame) -> DataFrame:
    """(from, spec, kind, path, pkg) of references of crates: crate from the nearest lib.rs or main.rs, self, and super upward; a name
    without :: may stand beside the file."""
    rows = uses.select("from", "spec").distinct().withColumn("dir", T.dir_of(F.col("from")))
    roots = files.where(F.col("path").rlike(r"(^|/)(lib|main)\.rs$")).select(T.dir_of(F.col("path")).alias("at"), T.dir_of(F.col("path")).alias("mark")).distinct()
    rows = rows.join(nearest(rows.select("dir").distinct(), roots, "crate"), "dir", "left")
    own = F.when(F.col("from").rlike(r"(^|/)(mod|lib|main)\.rs$"), F.col("dir")).otherwise(F.regexp_replace("from", r"\.rs$", ""))
    ups = F.regexp_count(F.regexp_extract("spec", r"^((?:super(?:::|$))*)", 1), F.lit("super"))
    first = F.regexp_extract("spec", "^([^:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace("spec", r"^(crate|self)(::|$)|^(super(::|$))+", ""), "::", "/")
    base = F.when(first == "crate", F.coalesce("crate", "dir")).when(ups > 0, F.concat(own, F.repeat(F.lit("/.."), ups))).otherwise(own)
    at = R.normalised(F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))
    beside = F.when(~F.col("spec").contains("::"), R.normalised(F.concat_ws("/", F.nullif("dir", F.lit("")), "spec")))
    ways = F.filter(F.flatten(F.transform(F.array(at, beside), lambda b: F.array(F.concat(b, F.lit(".rs")), F.concat(F.when(b == "", "").otherwise(F.concat(b, F.lit("/"))), F.lit("mod.rs"))))), lambda p: p.isNotNull())
    tried = rows.select("from", "spec", F.posexplode(ways).alias("place", "path"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy("from", "spec").agg(F.min_by("path", "place").alias("path"))
    kind = F.when(F.col("path").isNotNull(), "file").when(first.isin("crate", "self", "super"), "unresolved").otherwise("external")
    return rows.join(hit, ["from", "spec"], "left").select("from", "spec", kind.alias("kind"), "path", F.when(kind == "external", first).alias("pkg"))


def resolve_all(files: DataFrame, uses: DataFrame, own: Settings | None = None) -> DataFrame:
    """(from, spec, kind, path, pkg) of every reference by the rules of its language (X1). ``files``: path, text."""
    spark = files.sparkSession
    own = own or settings(files)
    rust, python = F.col("from").endswith(".rs"), F.col("from").rlike(r"\.pyi?$")
    bare = ~rust & ~python & ~F.col("spec").rlike(r"^\.\.?(/|$)|^/|^$") & F.col("from").rlike(r"(?i)\.([cm]?[jt]sx?|vue|svelte)$")
    paths = files.select("path")
    plain = R.resolve(paths, uses.where(~rust & ~bare))
    return plain.unionByName(resolve_rust(paths, uses.where(rust))).unionByName(resolve_bare(paths, uses.where(bare), rule_table(spark, own)))


def landed(uses: DataFrame, files: DataFrame, declared: DataFrame) -> DataFrame:
    """Uses of a Python package's names that are submodules lead to these, unless the package declares the name itself.

    ``uses``: from, to, names and more; ``declared``: path, name. A use whose names go to several files gives a row for each.
    """
    package = F.col("to").endswith("__init__.py") & (F.size("names") > 0)
    each = uses.where(package).withColumn("name", F.explode("names"))
    folder = F.regexp_replace("to", "__init__\\.py$", "")
    each = each.join(declared.select(F.col("path").alias("to"), "name", F.lit(True).alias("own")).distinct(), ["to", "name"], "left")
    there = files.select(F.col("path").alias("module")).distinct()
    flat = each.withColumn("module", F.concat(folder, "name", F.lit(".py"))).join(there.withColumn("is_file", F.lit(True)), "module", "left").withColumnRenamed("module", "file_path")
    both = flat.withColumn("module", F.concat(folder, "name", F.lit("/__init__.py"))).join(there.withColumn("is_dir", F.lit(True)), "module", "left")
    goes = F.when(F.col("own"), F.col("to")).when(F.col("is_file"), F.col("file_path")).when(F.col("is_dir"), F.col("module")).otherwise(F.col("to"))
    rest = [c for c in uses.columns if c not in ("to", "names")]
    moved = both.withColumn("goes", goes).groupBy(*rest, "goes").agg(F.array_sort(F.collect_set("name")).alias("names")).withColumnRenamed("goes", "to")
    return uses.where(~package).unionByName(moved.select(*uses.columns))
