"""References to files: probe paths in order of preference against the table of files, with joins.

Every reference becomes its probe paths with their places; one equi-join with the files and the least place decides. References that
are equal from the same folder are resolved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text as T

# Endings in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json", ".d.ts", ".vue", ".svelte", ".graphql", ".gql")
SOURCES = {".js": (".ts", ".tsx", "", ".d.ts"), ".jsx": (".tsx",), ".mjs": (".mts", "", ".d.mts"), ".cjs": (".cts", "", ".d.cts"), ".d.ts": (".ts", ".tsx", ""), ".d.mts": (".mts", ""), ".d.cts": (".cts", "")}


def normalised(path: Column) -> Column:
    """Without . and .. segments; null where it leaves the root."""
    step = lambda a, p: F.when(a.isNull() | p.isin("", "."), a).when(p == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1))).otherwise(F.concat(a, F.array(p)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(parts.isNotNull(), F.array_join(parts, "/"))


def probes(base: Column, folder_only: Column) -> Column:
    """Paths that a base may mean, in order: source for built endings, itself, with an ending, an index in it."""
    lit = lambda xs: F.array(*xs) if xs else F.array().cast("array<string>")
    built = F.array().cast("array<string>")
    for ending, sources in SOURCES.items():
        cut = F.substring(base, F.lit(1), F.length(base) - len(ending))
        built = F.when(base.endswith(ending), lit([F.concat(cut, F.lit(s)) if s else base for s in sources])).otherwise(built)
    own = F.concat(built, F.array(base), lit([F.concat(base, F.lit(e)) for e in EXTENSIONS]))
    index = lit([F.concat(base, F.when(base == "", "").otherwise("/"), F.lit("index" + e)) for e in EXTENSIONS])
    return F.when(folder_only, index).otherwise(F.concat(own, index))


def python_probes(folder: Column, spec: Column) -> Column:
    """A dotted module from its package, or from the folder upward and each src/ on the way."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.array_join(F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda x: x != ""), "/")
    up = normalised(F.concat_ws("/", folder, F.repeat(F.lit("../"), dots - 1), rest))
    above = F.reverse(F.concat(F.array(F.lit("")), T.ancestors(F.concat(folder, F.lit("/x")))))
    bases = F.when(dots > 0, F.array(up)).otherwise(F.flatten(F.transform(above, lambda d: F.array(F.ltrim(F.concat_ws("/", F.nullif(d, F.lit("")), rest)), F.concat_ws("/", F.nullif(d, F.lit("")), F.lit("src"), rest)))))
    return F.flatten(F.transform(bases, lambda b: F.array(F.concat(b, F.lit(".py")), F.concat_ws("/", F.nullif(b, F.lit("")), F.lit("__init__.py")))))


def resolve(files: DataFrame, uses: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(from, spec) with kind (file, external, unresolved), path and pkg.

    ``files``: path. ``packages``: pkg, dir and entry of packages that are here (several of a name: the shallowest counts).
    """
    folder = T.dir_of(F.col("from"))
    python = F.col("from").rlike(r"\.pyi?$")
    bare_spec = F.when(python, F.col("spec")).otherwise(F.regexp_replace("spec", r"(?<!^)[?#].*$", ""))
    rows = uses.select("from", "spec").distinct().withColumn("folder", folder).withColumn("s", bare_spec).withColumn("python", python)
    rows = rows.withColumn("relative", F.when(python, F.col("s").startswith(".")).otherwise(F.col("s").rlike(r"^\.\.?(/|$)")))
    rows = rows.withColumn("pkg", F.when(python, F.regexp_extract("s", r"^([^.]*)", 1)).otherwise(F.regexp_extract("s", r"(?i)^((?:@[a-z0-9][\w.-]*/)?[a-z0-9][\w.-]*)(?:/.*)?$", 1)))
    here = packages
    if here is not None:
        here = here.groupBy("pkg").agg(F.min(F.struct(F.length("dir"), "dir", "entry")).alias("k")).select("pkg", F.col("k.dir").alias("home"), F.col("k.entry").alias("entry"))
        rows = rows.join(here, "pkg", "left")
    else:
        rows = rows.withColumn("home", F.lit(None).cast("string")).withColumn("entry", F.lit(None).cast("string"))
    # Only distinct references of a folder are probed.
    kinds = rows.select("folder", "s", "python", "relative", "pkg", "home", "entry").distinct()
    base = F.when(F.col("relative"), normalised(F.concat_ws("/", F.nullif("folder", F.lit("")), F.col("s")))).when(F.col("home").isNotNull(), normalised(F.concat(F.col("home"), F.lit("/"), F.when(F.col("s") == F.col("pkg"), F.coalesce("entry", F.lit(""))).otherwise(F.substring(F.col("s"), F.length("pkg") + 2, F.length("s"))))))
    paths = F.when(F.col("python"), python_probes(F.col("folder"), F.col("s"))).when(base.isNotNull(), probes(base, F.col("s").rlike(r"^\.\.?$|/\.{0,2}$")))
    tried = kinds.select("folder", "s", "python", F.posexplode(paths).alias("place", "path")).where("path is not null")
    hit = tried.join(files.select("path").distinct(), "path").groupBy("folder", "s", "python").agg(F.min_by("path", "place").alias("path"))
    out = rows.join(hit, ["folder", "s", "python"], "left")
    kind = F.when(F.col("path").isNotNull(), "file").when(F.col("relative") | F.col("home").isNotNull() | (F.col("pkg") == ""), F.when(F.col("s").rlike("(?i)^[a-z][a-z0-9+.-]*:"), "external").otherwise("unresolved")).otherwise("external")
    return out.select("from", "spec", kind.alias("kind"), "path", F.when(kind == "external", F.when(F.col("pkg") == "", F.col("s")).otherwise(F.col("pkg"))).alias("pkg"))
