"""Signatures of units and descriptors of options: ranked facts within budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as T

# Fixed values.
KEEP, KEEP_PACKAGES, KEEP_NAMES, KEEP_ABOUT = 24, 12, 8, 320
SHOW = {"exports": 8, "imports": 6, "decls": 10, "calls": 8, "strings": 5, "headings": 10, "keys": 10, "tables": 10, "local": 6}
ABOUT_SHORT, ABOUT_LONG = 110, 240
HINT, EXPORTS = 110, 12
CHILDREN = 12


def ranked_names(facts: DataFrame, column: str, rarity: DataFrame) -> DataFrame:
    """(path, names): a list of each unit, the rarest word first, then in order; the KEEP first (G1).

    ``rarity``: word and its rarity; a name counts as its rarest word, an unknown one as 0.
    """
    each = facts.select("path", F.posexplode(F.array_distinct(column)).alias("at", "name"))
    words = each.select("name").distinct().select("name", F.explode_outer(T.ident_words(F.col("name"))).alias("word"))
    value = words.join(rarity, "word", "left").groupBy("name").agg(F.coalesce(F.max("rarity"), F.lit(0.0)).alias("r"))
    order = Window.partitionBy("path").orderBy(F.desc("r"), "at")
    top = each.join(value, "name").withColumn("k", F.row_number().over(order)).where(F.col("k") <= KEEP)
    return top.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("names"))


def exported(facts: DataFrame) -> DataFrame:
    """(path, exports): exported declarations and re-exported names, by line; default and star are left out."""
    own = F.transform(F.filter("decls", lambda d: d["exported"]), lambda d: F.struct(d["line"].alias("line"), d["name"].alias("name")))
    passed = F.flatten(F.transform(F.filter("imports", lambda i: i["how"] == "reexport"), lambda i: F.transform(i["names"], lambda n: F.struct(i["line"].alias("line"), n.alias("name")))))
    names = F.transform(F.array_sort(F.concat(own, passed)), lambda x: x["name"])
    return facts.select("path", F.slice(F.array_distinct(F.filter(names, lambda n: ~n.isin("default", "*"))), 1, KEEP).alias("exports"))


def packages(facts: DataFrame) -> DataFrame:
    """(path, imports array<struct<spec,names>>): packages with their names, in order of the first use; local files are left out."""
    each = facts.select("path", F.posexplode("imports").alias("at", "i")).where(~F.col("i.spec").rlike(r"^(\.|@/|~/)"))
    one = each.groupBy("path", F.col("i.spec").alias("spec")).agg(F.min("at").alias("at"), F.array_distinct(F.flatten(F.collect_list("i.names"))).alias("names"))
    names = F.slice(F.filter("names", lambda n: ~n.isin("default", "*")), 1, KEEP_NAMES)
    return one.groupBy("path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "spec", names.alias("names")))), lambda x: F.struct(x["spec"].alias("spec"), x["names"].alias("names"))), 1, KEEP_PACKAGES).alias("imports"))


def local_name(spec: Column) -> Column:
    """Name of a local import: its last part without ending, the folder for an index."""
    dotted = F.regexp_extract(spec, r"([A-Za-z_]\w*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(spec, r"(?i)\.(?:[cm]?[jt]sx?|json|s?css|svg|png|mdx?)$", ""), r"(/index)+$", "")
    last = F.regexp_extract(bare, r"([^/@~.][^/]*)$", 1)
    return F.when(spec.rlike(r"^\.+[\w.]*$"), dotted).otherwise(F.when(last == "index", "").otherwise(last))


def signatures(facts: DataFrame, rarity: DataFrame) -> DataFrame:
    """One row of ranked lists a unit; a list without entries is null (G1)."""
    out = facts.select("path", T.clip(F.col("about"), KEEP_ABOUT).alias("about"), F.slice("headings", 1, KEEP).alias("headings"), F.slice("tables", 1, KEEP).alias("tables"),
        F.slice(F.array_distinct(F.filter(F.transform(F.filter("imports", lambda i: i["spec"].rlike(r"^(\.|@/|~/)")), lambda i: local_name(i["spec"])), lambda n: n != "")), 1, KEEP).alias("local"))
    hidden = facts.select("path", "calls", "strings", "keys", F.transform(F.filter("decls", lambda d: ~d["exported"]), lambda d: d["name"]).alias("decls"))
    for c in ("decls", "calls", "strings", "keys"):
        out = out.join(ranked_names(hidden, c, rarity).withColumnRenamed("names", c), "path", "left")
    out = out.join(exported(facts), "path", "left").join(packages(facts), "path", "left")
    lists = ("headings", "tables", "local", "exports", "imports")
    return out.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in lists})


def fill(base: str, lists: dict[str, list[str]], about: str | None, budget: int) -> dict[str, object]:
    """A descriptor within ``budget`` characters (G2): a short about, then one entry of each list in turn as long as it fits, then a
    longer about with what is left. An entry that doesn't fit is passed over for those after it."""
    left = budget - len(base)
    out: dict[str, object] = {}
    for n in (ABOUT_SHORT, 80, 50):
        if about and (short := cut(about, n)) and len(short) + 12 <= left:
            out["about"] = short
            left -= len(short) + 12
            break
    queues = {k: list(v)[: SHOW.get(k, 10)] for k, v in lists.items() if v}
    while any(queues.values()):
        for k, queue in queues.items():
            while queue:
                item = queue.pop(0)
                cost = len(item) + 3 + (0 if k in out else len(k) + 6)
                if cost <= left:
                    out.setdefault(k, []).append(item)
                    left -= cost
                    break
    for n in (ABOUT_LONG, 200, 160, 130):
        if about and "about" in out and (long := cut(about, n)) and len(long) - len(out["about"]) <= left and len(long) > len(out["about"]):
            out["about"] = long
            break
    return out


def cut(text: str, cap: int) -> str:
    if len(text) <= cap:
        return text
    short = text[: cap - 1]
    word = re.sub(r"\s+\S*$", "", short)
    return (word if len(short) - len(word) <= 24 else short) + "…"


def round_robin(packages_: list[tuple[str, list[str]]]) -> list[str]:
    """Packages, then one name of each in turn."""
    out = [spec for spec, _ in packages_]
    for k in range(max((len(n) for _, n in packages_), default=0)):
        out += [names[k] for _, names in packages_ if k < len(names)]
    return out


def descriptors(signed: DataFrame, tokens: int = 160) -> DataFrame:
    """(path, descriptor as JSON) of every signature, each filled by itself."""
    budget = int(tokens * T.CHARS_PER_TOKEN)

    def run(batches: Iterator) -> Iterator:
        import json

        import pandas as pd

        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                lists = {k: list(r[k]) if r[k] is not None else [] for k in ("exports", "decls", "calls", "strings", "headings", "keys", "tables", "local")}
                lists["imports"] = round_robin([(i["spec"], list(i["names"])) for i in (r["imports"] if r["imports"] is not None else [])])
                rows.append((r["path"], json.dumps(fill(r["path"], lists, r["about"], budget), ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["path", "descriptor"])

    return signed.mapInPandas(run, "path string, descriptor string")


def hints(facts: DataFrame) -> DataFrame:
    """(path, hint, exports): the first heading of a document else what a unit is about, and its first exports."""
    head = F.when(F.col("path").rlike(r"(?i)\.mdx?$"), F.get("headings", 0))
    return facts.join(exported(facts), "path").select("path", T.clip(F.coalesce(head, "about"), HINT).alias("hint"), F.slice("exports", 1, EXPORTS).alias("exports"))


def previews(children: DataFrame, themes: DataFrame) -> DataFrame:
    """(dir, children, themes): what an option for a folder shows."""
    first = children.where(F.col("place") <= CHILDREN).groupBy(F.col("parent").alias("dir")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: T.base_name(x["path"])).alias("children"))
    words = themes.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("themes"))
    return first.join(words, "dir", "left")
