"""Reference graphs: merged edges, degrees, neighbours, hubs, coverage and chains of re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
STRENGTH = ("import", "require", "dynamic", "reexport")
MAX_HOPS = 8
HUB_SHARE, HUB_FLOOR = 0.98, 10


def merge(uses: DataFrame) -> DataFrame:
    """One edge for each (from, to) of uses (from, to, names, type_only, how, line, via): all names, the strongest way, the first line;
    type-only if all are, ``via`` only if no use is direct (X13). Loops are dropped."""
    strength = F.array_position(F.array(*[F.lit(s) for s in STRENGTH]), F.col("how"))
    own = uses.where(F.col("from") != F.col("to")).withColumn("strength", strength)
    rows = own.groupBy("from", "to").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
        F.bool_and("type_only").alias("type_only"),
        F.max("strength").cast("int").alias("strength"),
        F.min("line").alias("line"),
        F.when(F.count_if(F.col("via").isNull()) == 0, F.min("via")).alias("via"),
    )
    return rows.select("from", "to", "names", "type_only", F.element_at(F.array(*[F.lit(s) for s in STRENGTH]), F.col("strength")).alias("how"), "line", "via")


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out."""
    both = edges.select(F.col("to").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select("from", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def at_share(values: DataFrame, column: str, share: float) -> DataFrame:
    """One row: the value at place floor(n * share) of the sorted values, the last at most.

    Counts of equal values are enough, so the window is over distinct values only.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    upto = counts.select("v", F.sum("c").over(Window.orderBy("v")).alias("upto"))
    total = values.agg(F.count("*").alias("n"))
    return upto.crossJoin(F.broadcast(total)).where(F.col("upto") >= F.least(F.floor(F.col("n") * share) + 1, F.col("n"))).agg(F.min("v").alias("value"))


def hub_threshold(edges: DataFrame) -> DataFrame:
    """One row: fan-in from which a node is a hub (X21): the 98th of a hundred nodes, ten at least."""
    return at_share(degrees(edges), "fan_in", HUB_SHARE).select(F.greatest(F.coalesce("value", F.lit(0)), F.lit(HUB_FLOOR)).cast("long").alias("threshold"))


def neighbours(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """neighbour and its place: what ``node`` refers to first, then what refers to it, each once."""
    sides = []
    if direction in ("out", "both"):
        sides.append(edges.where(F.col("from") == node).select(F.col("to").alias("neighbour"), F.lit(0).alias("side"), "line"))
    if direction in ("in", "both"):
        sides.append(edges.where(F.col("to") == node).select(F.col("from").alias("neighbour"), F.lit(1).alias("side"), "line"))
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    first = rows.groupBy("neighbour").agg(F.min(F.struct("side", "line")).alias("k"))
    return first.select("neighbour", F.row_number().over(Window.orderBy("k", "neighbour")).alias("place"))


def external_users(external: DataFrame, pkg: str, name: str | None = None) -> DataFrame:
    """Who uses a package or a path below it, optionally by one name."""
    rows = external.where((F.col("pkg") == pkg) | F.col("spec").startswith(pkg + "/"))
    rows = rows.where(F.array_contains("names", name)) if name else rows
    return rows.groupBy("file").agg(F.min("line").alias("line")).orderBy("file")


def frontier(edges: DataFrame, examined: DataFrame) -> DataFrame:
    """node and links: what isn't examined and touches what is, over edges of either direction."""
    seen = examined.select("node").distinct()
    both = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).unionAll(edges.select("to", "from"))
    return both.join(seen.withColumnRenamed("node", "a"), "a", "left_semi").join(seen.withColumnRenamed("node", "b"), "b", "left_anti").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("links"))


def coverage(nodes: DataFrame, edges: DataFrame, examined: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row of counts: nodes, examined, unexamined, frontier, unresolved references."""
    own = examined.select("node").distinct().join(nodes.select("node").distinct(), "node", "left_semi")
    return (
        nodes.agg(F.countDistinct("node").alias("nodes"))
        .crossJoin(own.agg(F.count("*").alias("examined")))
        .crossJoin(frontier(edges, examined).agg(F.count("*").alias("frontier")))
        .crossJoin(unresolved.agg(F.count("*").alias("unresolved")))
        .withColumn("unexamined", F.col("nodes") - F.col("examined"))
    )


def through_barrels(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """Uses (from, to, names, type_only, how, line) with ``via``: each name of a use goes to the file that declares it, through the
    re-exports of the files on its way (X14). A named re-export comes before a declaration of the file, then stars, then nothing.

    ``declared``: path, name. A use without names, or of names that no re-export passes on, stays as it is.
    """
    passes = uses.where("how = 'reexport'").select(F.col("from").alias("file"), F.explode("names").alias("name"), "to").distinct()
    named = passes.where("name <> '*'").select("file", "name", "to", F.col("name").alias("to_name"), F.lit(0).alias("priority"))
    each = uses.where(F.size("names") > 0).withColumn("name", F.explode("names"))
    asked = each.where("how <> 'reexport' and name <> '*'").select(F.col("to").alias("file"), "name").distinct()
    local = declared.select(F.col("path").alias("file"), "name").distinct()
    # A star passes on what its target declares itself, and further what named re-exports of the target do.
    stars = passes.where("name = '*'").select("file", F.col("to").alias("target"))
    given = local.unionByName(named.select("file", "name")).distinct()
    star = stars.join(given.withColumnRenamed("file", "target"), "target").select("file", "name", F.col("target").alias("to"), F.col("name").alias("to_name"), F.lit(2).alias("priority"))
    star = star.join(local, ["file", "name"], "left_anti")
    ends = chase(asked, named.unionByName(star)).select(F.col("file").alias("to"), "name", "defined_in", "hops")
    moved = each.join(ends, ["to", "name"], "left").withColumn("goes", F.when((F.col("hops") > 0) & (F.col("how") != "reexport"), F.col("defined_in")).otherwise(F.col("to")))
    rows = moved.groupBy("from", "to", "type_only", "how", "line", "goes").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = rows.select("from", F.col("goes").alias("to"), "names", "type_only", "how", "line", F.when(F.col("goes") != F.col("to"), F.col("to")).alias("via"))
    return rows.unionByName(uses.where(F.size("names") == 0).withColumn("via", F.lit(None).cast("string")).select(*rows.columns))


def chase(start: DataFrame, reexports: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """Where a name is defined (X14): follow (file, name) through re-exports (file, name, to, to_name, priority) to the end.

    The best way of a file is the one of least priority, then of least target. A round is one equi-join on what still moves; loops
    end where they come back, or at the limit of hops, with the last file reached.
    """
    best = reexports.withColumn("k", F.row_number().over(Window.partitionBy("file", "name").orderBy("priority", "to", "to_name"))).where("k = 1").select(F.col("file").alias("f"), F.col("name").alias("m"), "to", "to_name")
    rows = start.select("file", "name", F.col("file").alias("at"), F.col("name").alias("at_name"), F.lit(0).alias("hops"), F.array(F.struct("file", "name")).alias("seen"))
    for _ in range(hops):
        step = rows.join(best, (rows["at"] == best["f"]) & (rows["at_name"] == best["m"]), "left")
        here = F.struct(F.col("to").alias("file"), F.col("to_name").alias("name"))
        go = F.col("to").isNotNull() & ~F.array_contains("seen", here)
        rows = step.select("file", "name", F.when(go, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(go, F.col("to_name")).otherwise(F.col("at_name")).alias("at_name"), (F.col("hops") + go.cast("int")).alias("hops"), F.when(go, F.concat("seen", F.array(here))).otherwise(F.col("seen")).alias("seen"))
    return rows.select("file", "name", F.col("at").alias("defined_in"), F.col("at_name").alias("defined_as"), "hops")


def outside(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What leads out of the files (X16): external (file, spec, pkg, names of all its uses, first line) and unresolved (file, spec), each once."""
    ext = resolved.where("kind = 'external'").groupBy(F.col("from").alias("file"), "spec", "pkg").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.min("line").alias("line"))
    return ext, resolved.where("kind = 'unresolved'").select(F.col("from").alias("file"), "spec").distinct()


def members(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Every file of a graph (X17): those with facts and those that are only referred to."""
    return units.select("path").union(edges.select("to")).distinct()
