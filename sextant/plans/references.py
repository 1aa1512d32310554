"""Registered queries of facts and references over files made of parts, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import facts
from sextant.functions.text import Duck
from sextant.operators import graph as X
from sextant.operators import projects as P
from sextant.operators import resolve as R
from sextant.operators import signature as G
from sextant.operators import tree as H
from sextant.plans.structure import files
from sextant.sources import sinks as K
from sextant.sources.tables import table

#: Name and text of a file for each kind; {k} is the part's key, {n} its name.
KINDS = {
    "a{k}.ts": '// Makes {n}.\nimport {{ a{k} }} from "./m{k}";\nexport function f{k}() {{ return call{k}("text{k}"); }}\n',
    "a{k}.py": '"""Makes {n}."""\nfrom .m{k} import a\nclass C{k}:\n    pass\n',
    "a{k}.rs": "// Makes {n}.\nuse crate::m{k}::{{A}};\npub struct S{k};\n",
    "a{k}.go": 'package p\nimport "x/m{k}"\nfunc F{k}() {{}}\n',
    "a{k}.java": "import a.b.M{k};\npublic class K{k} {{}}\n",
    "a{k}.sh": "source ./m{k}.sh\nrun{k}() {{\n:\n}}\n",
    "a{k}.scss": '@import "m{k}.css";\n@mixin x{k} {{}}\n',
    "a{k}.graphql": "type T{k} {{ a: Int }}\n",
    "a{k}.sql": "create view v{k} as select * from orders{k}\n",
    "a{k}.md": "# Head {k}\n\nMakes {n}.\n",
    "a{k}.json": '{{"k{k}": {{"in": 1}}}}',
    "a{k}.yaml": "a{k}:\n  b: 1\n",
    "a{k}.csv": "id,c{k}\n1,2\n",
    "a{k}.html": "<title>Page {k}</title><h2>H{k}</h2>",
    "dockerfile.{k}": "FROM img{k} AS st{k}\n",
    "a{k}.vue": '<script>import x from "./m{k}"\n</script><template><Card{k}/></template>',
}
LISTS = ("calls", "strings", "headings", "keys", "tables")


def _filled(template: str) -> Column:
    text = template.replace("{{", "\1").replace("}}", "\2")
    out, name = F.lit(text), F.col("p_name")
    out = F.replace(F.replace(out, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{n}"), name)
    return F.replace(F.replace(out, F.lit("\1"), F.lit("{")), F.lit("\2"), F.lit("}"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_partkey") % len(KINDS)
    path = reduce(lambda a, i: F.when(kind == i[0], _filled(i[1])).otherwise(a), enumerate(KINDS), F.lit(None).cast("string"))
    text = reduce(lambda a, i: F.when(kind == i[0], _filled(i[1])).otherwise(a), enumerate(KINDS.values()), F.lit(None).cast("string"))
    return table(spark, sf, "part").select(F.concat(F.lit("d/"), path).alias("path"), text.alias("text"))


def source_facts(spark: SparkSession, sf: str) -> DataFrame:
    got = facts.extract(sources(spark, sf))
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",").alias(c)
    return got.select("path", F.coalesce("about", F.lit("")).alias("about"), names("decls", "name"), names("imports", "spec"), *[F.array_join(c, ",").alias(c) for c in LISTS])


def source_signatures(spark: SparkSession, sf: str) -> DataFrame:
    got = facts.extract(sources(spark, sf))
    rarity = table(spark, sf, "part").select(F.concat(F.lit("call"), F.col("p_partkey").cast("string")).alias("word"), F.lit(1.0).alias("rarity"))
    signed = G.signatures(got, rarity)
    return signed.select("path", F.coalesce("about", F.lit("")).alias("about"), *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("exports", "decls", "calls", "local", "keys")])


def source_hints(spark: SparkSession, sf: str) -> DataFrame:
    return G.hints(facts.extract(sources(spark, sf))).select("path", F.coalesce("hint", F.lit("")).alias("hint"), F.array_join("exports", ",").alias("exports"))


def descriptor_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors stay within their budget and hold what fits (G2, G3): here all names of a file do."""
    got = facts.extract(sources(spark, sf))
    rarity = spark.createDataFrame([("x", 1.0)], "word string, rarity double")
    return G.descriptors(G.signatures(got, rarity)).select("path", (F.length("descriptor") <= 160 * 4).alias("fits"), F.coalesce(F.get_json_object("descriptor", "$.exports[0]"), F.lit("")).alias("first"))


def _k() -> Column:
    return F.col("p_partkey")


def _t() -> Column:
    """The part that another refers to."""
    return (F.col("p_partkey") * 7) % 250


def _name(stem: str, key: Column) -> Column:
    return F.concat(F.lit(stem), key.cast("string"))


def modules(spark: SparkSession, sf: str) -> DataFrame:
    """g0 to g9, each with its settings, and a module for each part: .ts, .js or a folder with an index."""
    own = table(spark, sf, "part").select(F.concat(_name("g", _k() % 10), F.lit("/src/"), _name("m", _k()), F.when(_k() % 3 == 0, ".ts").when(_k() % 3 == 1, ".js").otherwise("/index.tsx")).alias("path"), F.lit("").alias("text"))
    rows = [(f"g{j}/tsconfig.json", '{"compilerOptions": {"paths": {"@m/*": ["src/*"]}}}') for j in range(10)] + [(f"g{j}/package.json", f'{{"name": "pkg{j}", "exports": {{"./*": "./dist/*.js"}}}}') for j in range(10)]
    return own.unionByName(spark.createDataFrame(rows, "path string, text string"))


def _uses(spark: SparkSession, sf: str, spec: Column) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(_name("g", _k() % 10), F.lit("/src/"), _name("n", _k()), F.lit(".ts")).alias("from"), spec.alias("spec"))


def resolve_relative(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve(modules(spark, sf).select("path"), _uses(spark, sf, _name("./m", _t()))).select("from", "spec", "kind", "path")


def resolve_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return P.resolve_all(modules(spark, sf), _uses(spark, sf, _name("@m/m", _t()))).select("from", "spec", "kind", "path")


def resolve_packages(spark: SparkSession, sf: str) -> DataFrame:
    return P.resolve_all(modules(spark, sf), _uses(spark, sf, F.concat(_name("pkg", _k() % 12), F.lit("/"), _name("m", _t())))).select("from", "spec", "kind", "path", F.coalesce("pkg", F.lit("")).alias("pkg"))


def resolve_crates(spark: SparkSession, sf: str) -> DataFrame:
    crate = F.concat(_name("c", _k() % 5), F.lit("/src/"))
    files = table(spark, sf, "part").select(F.concat(crate, _name("r", _k()), F.lit(".rs")).alias("path")).union(table(spark, sf, "part").select(F.concat(crate, F.lit("lib.rs")))).distinct()
    spec = F.when(_k() % 3 == 0, _name("crate::r", _t())).when(_k() % 3 == 1, _name("super::r", _t())).otherwise(_name("serde::r", _t()))
    return P.resolve_rust(files, table(spark, sf, "part").select(F.concat(crate, _name("r", _k()), F.lit(".rs")).alias("from"), spec.alias("spec"))).select("from", "spec", "kind", "path")


def resolve_python(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.concat(_name("py", _k() % 4), F.lit("/pk/"))
    own = table(spark, sf, "part").select(F.concat(folder, _name("m", _k()), F.lit(".py")).alias("path"))
    uses = table(spark, sf, "part").select(F.concat(folder, _name("m", _k()), F.lit(".py")).alias("from"), F.concat(F.when(_k() % 2 == 0, ".").otherwise("pk."), _name("m", _t())).alias("spec"))
    return R.resolve(own, uses).select("from", "spec", "kind", "path")


def submodule_uses(spark: SparkSession, sf: str) -> DataFrame:
    uses = table(spark, sf, "part").select(_name("u", _k()).alias("from"), F.lit("pk/__init__.py").alias("to"), F.array(_name("m", _t()), F.lit("shown")).alias("names"), F.lit(1).alias("line"))
    files = table(spark, sf, "part").select(F.concat(F.lit("pk/"), _name("m", _k()), F.when(_k() % 2 == 0, ".py").otherwise("/__init__.py")).alias("path"))
    declared = spark.createDataFrame([("pk/__init__.py", "shown"), ("pk/__init__.py", "m7")], "path string, name string")
    return P.landed(uses, files, declared).withColumn("names", F.array_join("names", ",")).drop("line")


def barrel_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A barrel names every third part's module and passes on the names of every fifth by a star."""
    part = table(spark, sf, "part")
    uses = part.select(_name("u", _k()).alias("from"), F.lit("b").alias("to"), F.array(_name("x", _k())).alias("names"), F.lit("import").alias("how"))
    named = part.where("p_partkey % 3 = 0").select(F.lit("b").alias("from"), _name("f", _k()).alias("to"), F.array(_name("x", _k())).alias("names"), F.lit("reexport").alias("how"))
    stars = part.where("p_partkey % 5 = 0 and p_partkey % 3 > 0").select(F.lit("b").alias("from"), _name("f", _k()).alias("to"), F.array(F.lit("*")).alias("names"), F.lit("reexport").alias("how"))
    rows = reduce(DataFrame.unionByName, (uses, named, stars)).withColumn("type_only", F.lit(False)).withColumn("line", F.lit(1))
    declared = part.select(_name("f", _k()).alias("path"), _name("x", _k()).alias("name"))
    return X.through_barrels(rows, declared).where("how = 'import'").select("from", "to", F.array_join("names", ",").alias("names"), F.coalesce("via", F.lit("")).alias("via"))


def files_under(spark: SparkSession, sf: str) -> DataFrame:
    return H.files_under(H.nodes(files(spark, sf)), "en/src3")


def tree_json(spark: SparkSession, sf: str) -> DataFrame:
    tree = H.nodes(files(spark, sf).where("path like '%/src1/%'"))
    return K.tree_json(tree).where("path not like '%.txt'").select("path", F.get_json_object("node", "$.files").cast("long").alias("files"), F.get_json_object("node", "$.children[0]").alias("first"))


def source_shards(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).groupBy(K.shard(F.col("path")).alias("shard")).agg(F.count("*").alias("files"), F.min("path").alias("first"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(_k() % 3 == 0, "external").when(_k() % 3 == 1, "unresolved").otherwise("file")
    return table(spark, sf, "part").select(F.col("p_brand").alias("from"), F.col("p_type").alias("spec"), F.col("p_type").alias("pkg"), F.array("p_name").alias("names"), _k().alias("line"), kind.alias("kind"))


def external_lists(spark: SparkSession, sf: str) -> DataFrame:
    return X.outside(_resolved(spark, sf))[0].withColumn("names", F.array_join("names", ","))


def unresolved_list(spark: SparkSession, sf: str) -> DataFrame:
    return X.outside(_resolved(spark, sf))[1]


def graph_members(spark: SparkSession, sf: str) -> DataFrame:
    return X.members(table(spark, sf, "part").select(_name("g", _k() % 7).alias("path")), table(spark, sf, "part").select(_name("g", _t() % 19).alias("to")))


def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("payload"))
    return K.frames(own)


QUERIES = {f.__name__: f for f in (files_under, tree_json, source_shards, external_lists, unresolved_list, graph_members, event_frames, source_facts, source_signatures, source_hints, descriptor_sizes, resolve_relative, resolve_patterns, resolve_packages, resolve_crates, resolve_python, submodule_uses, barrel_edges)}

def _cases(values: dict[int, str], other: str = "''") -> str:
    """SQL by kind: {k} and {n} in a value are the part's."""
    text = lambda v: "'" + v.replace("{k}", "' || p_partkey || '").replace("{n}", "' || p_name || '") + "'"
    return f"CASE p_partkey % {len(KINDS)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in values.items()) + f" ELSE {other} END"


_ABOUT = {0: "Makes {n}.", 1: "Makes {n}.", 2: "Makes {n}.", 9: "Makes {n}.", 13: "Page {k}"}
_DECLS = {0: "f{k}", 1: "C{k}", 2: "S{k}", 3: "F{k}", 4: "K{k}", 5: "run{k}", 6: "x{k}", 7: "T{k}", 8: "v{k}", 14: "st{k}"}
_IMPORTS = {0: "./m{k}", 1: ".m{k}", 2: "crate::m{k}", 3: "x/m{k}", 4: "a.b.M{k}", 5: "./m{k}.sh", 6: "m{k}.css", 14: "img{k}", 15: "./m{k}"}
_CALLS, _KEYS = {0: "call{k}", 15: "Card{k}"}, {7: "T{k}.a", 10: "k{k},k{k}.in", 11: "a{k},a{k}.b", 12: "id,c{k}"}
_PATH = "'d/' || " + _cases({i: p for i, p in enumerate(KINDS)}, "NULL")
_AT = "concat('g', p_partkey % 10, '/src/n', p_partkey, '.ts')"
_MODULE = "concat('g', t % 10, '/src/m', t, CASE t % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.tsx' END)"
_TO = "x AS (SELECT p_partkey, p_partkey * 7 % 250 AS t, p_partkey * 7 % 250 IN (SELECT p_partkey FROM part) AS there FROM part)"


def _found(query: str, spec: str, here: str, kind: str = "'unresolved'", more: str = "") -> str:
    return f"""WITH {_TO} SELECT {query} AS "from", {spec} AS spec, CASE WHEN {here} THEN 'file' ELSE {kind} END AS kind, CASE WHEN {here} THEN {{path}} END AS path{more} FROM x"""


SQL = {
    "files_under": f"WITH {Duck.units()} SELECT path FROM units WHERE starts_with(path, 'en/src3/')",
    "tree_json": """WITH d AS (SELECT lang, 'doc_' || doc_id || '.txt' AS n FROM documents WHERE source = 'src1')
        SELECT lang || '/src1' AS path, count(*) AS files, min(n) AS first FROM d GROUP BY lang UNION ALL SELECT lang, count(*), 'src1' FROM d GROUP BY lang UNION ALL SELECT '', count(*), min(lang) FROM d""",
    "source_shards": f"WITH {Duck.units()} SELECT substr(sha256(path), 1, 2) AS shard, count(*) AS files, min(path) AS first FROM units GROUP BY 1",
    "external_lists": "SELECT p_brand AS file, p_type AS spec, p_type AS pkg, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names, min(p_partkey) AS line FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL",
    "unresolved_list": "SELECT DISTINCT p_brand AS file, p_type AS spec FROM part WHERE p_partkey % 3 = 1",
    "graph_members": "SELECT 'g' || (p_partkey % 7) AS path FROM part UNION SELECT 'g' || (p_partkey * 7 % 250 % 19) FROM part",
    "event_frames": """SELECT user_id AS run, event_id AS seq, 'event: ' || event_type || chr(10) || 'data: {"type":"' || event_type || '","payload":' || props || '}' || chr(10) || chr(10) AS frame FROM events""",
    "source_facts": f"""SELECT {_PATH} AS path, {_cases(_ABOUT)} AS about, {_cases(_DECLS)} AS decls, {_cases(_IMPORTS)} AS imports, {_cases(_CALLS)} AS calls, {_cases({0: "text{k}"})} AS strings,
        {_cases({9: "Head {k}", 13: "H{k}"})} AS headings, {_cases(_KEYS)} AS keys, {_cases({8: "orders{k}"})} AS tables FROM part""",
    "source_signatures": f"""SELECT {_PATH} AS path, {_cases(_ABOUT)} AS about, {_cases(_DECLS)} AS exports, '' AS decls, {_cases(_CALLS)} AS calls, {_cases({0: "m{k}", 1: "m{k}", 5: "m{k}.sh", 15: "m{k}"})} AS "local", {_cases(_KEYS)} AS keys FROM part""",
    "source_hints": f"SELECT {_PATH} AS path, {_cases({**_ABOUT, 9: 'Head {k}'})} AS hint, {_cases(_DECLS)} AS exports FROM part",
    "descriptor_sizes": f"SELECT {_PATH} AS path, true AS fits, {_cases(_DECLS)} AS first FROM part",
    "resolve_relative": _found(_AT, "'./m' || t", "there AND t % 10 = p_partkey % 10").format(path=_MODULE),
    "resolve_patterns": _found(_AT, "'@m/m' || t", "there AND t % 10 = p_partkey % 10").format(path=_MODULE),
    "resolve_packages": _found(_AT, "'pkg' || (p_partkey % 12) || '/m' || t", "there AND t % 10 = p_partkey % 12", "CASE WHEN p_partkey % 12 > 9 THEN 'external' ELSE 'unresolved' END", ", CASE WHEN p_partkey % 12 > 9 THEN 'pkg' || (p_partkey % 12) ELSE '' END AS pkg").format(path=_MODULE),
    "resolve_crates": _found("concat('c', p_partkey % 5, '/src/r', p_partkey, '.rs')", "['crate::r', 'super::r', 'serde::r'][p_partkey % 3 + 1] || t", "p_partkey % 3 < 2 AND there AND t % 5 = p_partkey % 5", "CASE WHEN p_partkey % 3 = 2 THEN 'external' ELSE 'unresolved' END").format(path="concat('c', t % 5, '/src/r', t, '.rs')"),
    "resolve_python": _found("concat('py', p_partkey % 4, '/pk/m', p_partkey, '.py')", "['.', 'pk.'][p_partkey % 2 + 1] || 'm' || t", "there AND t % 4 = p_partkey % 4", "CASE WHEN p_partkey % 2 = 1 THEN 'external' ELSE 'unresolved' END").format(path="concat('py', t % 4, '/pk/m', t, '.py')"),
    "submodule_uses": f"""WITH {_TO}, s AS (SELECT *, there AND t <> 7 AS goes FROM x)
        SELECT 'u' || p_partkey AS "from", 'pk/m' || t || (CASE WHEN t % 2 = 0 THEN '.py' ELSE '/__init__.py' END) AS "to", 'm' || t AS names FROM s WHERE goes
        UNION ALL SELECT 'u' || p_partkey, 'pk/__init__.py', CASE WHEN goes THEN 'shown' ELSE 'm' || t || ',shown' END FROM s""",
    "barrel_edges": """SELECT 'u' || p_partkey AS "from", CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'f' || p_partkey ELSE 'b' END AS "to", 'x' || p_partkey AS names, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'b' ELSE '' END AS via FROM part""",
}
