"""Hierarchies of units: materialised nodes, rollups over ancestors, themes, nearest ancestors and heat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as T

THEMES = 16


def nodes(files: DataFrame) -> DataFrame:
    """Every file of (path, size) and every folder above one: path, parent, name, kind, depth, size, files.

    One exchange: a file is exploded to itself and its ancestors, and sums are partial before they move.
    """
    path = F.col("path")
    each = files.select(F.explode(F.concat(F.array(F.struct(F.lit("").alias("p"), F.lit("dir").alias("k"))), F.transform(T.ancestors(path), lambda a: F.struct(a.alias("p"), F.lit("dir").alias("k"))), F.array(F.struct(path.alias("p"), F.lit("file").alias("k"))))).alias("x"), "size")
    sums = each.groupBy(F.col("x.p").alias("path"), F.col("x.k").alias("kind")).agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    return sums.select("path", T.dir_of(path).alias("parent"), T.base_name(path).alias("name"), "kind", F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).alias("depth"), "size", "files")


def children(tree: DataFrame) -> DataFrame:
    """Children of each folder in order: folders first, then by name."""
    own = tree.where("path <> ''")
    return own.select("parent", "path", F.row_number().over(Window.partitionBy("parent").orderBy("kind", "name")).alias("place"))


def files_under(tree: DataFrame, scope: str) -> DataFrame:
    return tree.where((F.col("kind") == "file") & T.under(F.col("path"), scope)).select("path")


def themes(files: DataFrame, generic: list[str], top: int = THEMES) -> DataFrame:
    """dir, word, score, rank: words of names below a folder, by count here squared over count in the whole collection."""
    path = F.col("path")
    own = files.select(path, F.explode(T.ancestors(path)).alias("dir"), T.base_name(path).alias("name"))
    below = own.select("dir", "name").unionByName(files.select(F.explode(T.ancestors(path)).alias("sub")).distinct().select(F.explode(T.ancestors(F.col("sub"))).alias("dir"), T.base_name(F.col("sub")).alias("name")))
    here = below.select("dir", F.explode(T.name_words(F.col("name"), generic)).alias("word")).groupBy("dir", "word").agg(F.count("*").alias("here"))
    names = files.select(T.base_name(path).alias("name")).unionByName(files.select(F.explode(T.ancestors(path)).alias("d")).distinct().select(T.base_name(F.col("d")).alias("name")))
    whole = names.select(F.explode(T.name_words(F.col("name"), generic)).alias("word")).groupBy("word").agg(F.count("*").alias("all"))
    scored = here.join(whole, "word").select("dir", "word", F.round(F.col("here") * F.col("here") / F.col("all"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("score"), "word"))).where(F.col("rank") <= top)


def nearest(paths: DataFrame, marks: DataFrame) -> DataFrame:
    """path and the deepest folder above it that is in ``marks`` (dir), never the root (X3, W2); the first folder without one."""
    above = paths.select("path", F.posexplode(T.ancestors(F.col("path"))).alias("depth", "dir"))
    found = above.join(marks.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", "depth").alias("near"))
    return paths.select("path").join(found, "path", "left").select("path", F.coalesce("near", F.regexp_extract("path", "^([^/]*)/", 1)).alias("cluster"))


def heat(judged: DataFrame, with_root: bool = False) -> DataFrame:
    """path and heat of every judged file and of every folder above one: the most below it, a null judgment as 0 (NAV6, NAV7)."""
    value = F.coalesce("value", F.lit(0.0))
    up = F.concat(F.array(F.lit("")), T.ancestors(F.col("path"))) if with_root else T.ancestors(F.col("path"))
    return judged.select(F.explode(F.concat(F.array("path"), up)).alias("path"), value.alias("value")).groupBy("path").agg(F.max("value").alias("heat"))
