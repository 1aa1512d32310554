"""Fielded lexical retrieval: index tables, BM25F search over them or straight over units, pools, anchors and evidence.

Two ways to search give the same rows. ``search`` reads index tables (many queries, one index). ``search_units`` reads the units
once for a single query: the counts of the few query words are found by patterns in each unit's text and written as a narrow table, so
nothing is exploded, and the only exchanges are the global counts and the top rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.sources.shared import written

# Fixed values.
K1 = 1.2
WEIGHT = {"path": 4.0, "sig": 2.5, "body": 1.0}
B = {"path": 0.4, "sig": 0.6, "body": 0.75}
VIEWS = {"all": ("path", "sig", "body"), "path": ("path",), "path+sig": ("path", "sig")}
POOL_ALL, POOL_PATH, POOL_SIG = 32, 10, 0

FIELDS = tuple(WEIGHT)


@dataclass(frozen=True)
class Term:
    label: str
    variants: tuple[str, ...]
    weight: float = 1.0


def cap(x: float | None, default: int) -> int:
    """A count option: absent is the default, a fraction is cut, what isn't a number or is below 0 is 0."""
    if x is None:
        return default
    return 0 if math.isnan(x) else max(0, int(min(x, 2**31 - 1)))


def plain_stem(word: str) -> str:
    """``T.stem`` of one word."""
    if len(word) < 4 or not word.endswith("s"):
        return word
    if len(word) > 4 and word.endswith("ies") and word[-4] not in "ea":
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("xes", "zes", "ches", "shes", "sses")):
        return word[:-2]
    return word if word[-2] in "sui" else word[:-1]


def field_tokens(units: DataFrame) -> DataFrame:
    """path and the tokens of each field; null fields are empty."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    return units.select("path", T.path_tokens(col("path")).alias("t_path"), T.tokenize(col("sig")).alias("t_sig"), T.body_tokens(col("body")).alias("t_body"))


@dataclass
class Index:
    postings: DataFrame  # path, term, tf_path, tf_sig, tf_body
    doc_stats: DataFrame  # path, len_path, len_sig, len_body


def build(units: DataFrame) -> Index:
    """Postings with a count for each field, and lengths (L1). Counts saturate, lengths don't.

    A unit's tokens are counted in its own row: no task holds the terms of many. Only units that share a path are merged by a shuffle.
    """
    stats = field_tokens(units).select("path", *[F.size(f"t_{f}").alias(f"len_{f}") for f in FIELDS])
    again = written(units.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("again")))
    same = F.col("path").eqNullSafe(F.col("again"))
    names = [f"tf_{f}" for f in FIELDS]
    alone, shared = (_counts(units.join(again, same, how)) for how in ("left_anti", "left_semi"))
    counts = alone.unionByName(shared.groupBy("path", "term").agg(*[F.sum(c).alias(c) for c in names]))
    return Index(counts.select("path", "term", *[F.least(c, F.lit(T.MAX_TF)).alias(c) for c in names]), stats)


def _counts(units: DataFrame) -> DataFrame:
    """path, term and the term's count in each field: the tokens are sorted, so that those of a term are a run."""
    each = F.sort_array(F.flatten(F.array(*[F.transform(f"t_{f}", _place(i)) for i, f in enumerate(FIELDS)])))
    rows = field_tokens(units).select("path", each.alias("each"))
    begins = lambda x, i: F.struct(x["term"].alias("term"), i.alias("at"), ((i == 0) | (x["term"] != F.get("each", i - 1)["term"])).alias("begins"))
    rows = rows.select("path", "each", F.filter(F.transform("each", begins), lambda x: x["begins"]).alias("runs"))
    run = lambda x, k: F.slice("each", x["at"] + 1, F.coalesce(F.get("runs", k + 1)["at"], F.size("each")) - x["at"])
    tf = lambda own, i: F.size(F.filter(own, lambda y: y["field"] == i)).cast("long")
    counted = F.transform("runs", lambda x, k: F.struct(x["term"].alias("term"), *[tf(run(x, k), i).alias(f"tf_{f}") for i, f in enumerate(FIELDS)]))
    return rows.select("path", F.explode(counted).alias("x")).select("path", "x.*")


def _place(field: int):
    return lambda t: F.struct(t.alias("term"), F.lit(field).alias("field"))


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """One row: documents and mean lengths; a mean of 0 or none is 1."""
    return doc_stats.agg(F.count("*").alias("n"), *[F.coalesce(F.nullif(F.avg(f"len_{f}"), F.lit(0.0)), F.lit(1.0)).alias(f"avg_{f}") for f in FIELDS])


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def vocabulary(index: Index) -> DataFrame:
    """term and in how many documents it stands (L2)."""
    return index.postings.groupBy("term").agg(F.count("*").alias("df"))


def rarity(names: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """name and the inverse document frequency of its rarest token; unseen tokens have frequency 0, no token gives 0 (L3)."""
    each = names.select("name", F.explode(F.array_distinct(T.tokenize(F.col("name")))).alias("term")).join(vocab, "term", "left")
    got = each.groupBy("name").agg(F.max(idf(F.lit(n), F.coalesce("df", F.lit(0)))).alias("rarity"))
    return names.select("name").distinct().join(got, "name", "left").select("name", F.coalesce("rarity", F.lit(0.0)).alias("rarity"))


def group_df(index: Index, terms: list[Term]) -> DataFrame:
    """label and how many documents have any variant (L4)."""
    return index.postings.join(F.broadcast(term_rows(index.postings.sparkSession, terms)), "term").groupBy("label").agg(F.countDistinct("path").alias("df"))


def unit_df(units: DataFrame, terms: list[Term]) -> dict[str, int]:
    """The same without an index, as a dict: one pass over the units; a term without documents has 0."""
    live = [t for t in terms if t.weight > 0 and t.variants]
    if not live:
        return {}
    held = lambda t: F.exists("t_all", lambda x: x.isin(*t.variants))
    toks = field_tokens(units).select(F.concat(*[f"t_{f}" for f in FIELDS]).alias("t_all"))
    row = toks.agg(*[F.count_if(held(t)).alias(f"d{i}") for i, t in enumerate(live)]).first()
    return {t.label: row[i] for i, t in enumerate(live)}


def term_rows(spark: SparkSession, terms: list[Term]) -> DataFrame:
    rows = [(i, t.label, v, float(t.weight)) for i, t in enumerate(terms) if t.weight > 0 for v in dict.fromkeys(t.variants)]
    return spark.createDataFrame(rows, "ti int, label string, term string, weight double")


def _wtf(view: str) -> Column:
    """Weighted, length-normalised count of a variant over the fields of a view."""
    parts = [WEIGHT[f] * F.col(f"tf_{f}") / (1 - B[f] + B[f] * F.col(f"len_{f}") / F.col(f"avg_{f}")) for f in VIEWS[view]]
    return reduce(lambda a, b: a + b, parts)


def best(scored: DataFrame, scope: str, limit: int | None) -> DataFrame:
    """Scope after scoring, rounding before ranking, ties by path; without a limit all, unranked."""
    rows = scored.where(T.under(F.col("path"), scope)).withColumn("score", F.round("score", 6)).where("score > 0")
    return rows if limit is None else rows.orderBy(F.desc("score"), "path").limit(cap(limit, 0))


def ranked(scored: DataFrame, scope: str, limit: int) -> DataFrame:
    """The best rows with their ranks; only these, a bounded number, are numbered."""
    return best(scored, scope, limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def scores(index: Index, terms: list[Term], view: str = "all") -> DataFrame:
    """path, score, matched of every document that holds a query word, by BM25F (L6, L7). Only the query's few words are broadcast."""
    spark = index.postings.sparkSession
    hits = index.postings.join(F.broadcast(term_rows(spark, terms)), "term").join(index.doc_stats, "path").crossJoin(F.broadcast(corpus_stats(index.doc_stats)))
    acc = hits.withColumn("wtf", _wtf(view)).where("wtf > 0").groupBy("path", "ti", "label", "weight", "n").agg(F.sum("wtf").alias("acc"))
    df = acc.groupBy("ti").agg(F.count("*").alias("df"))
    part = acc.join(F.broadcast(df), "ti").withColumn("gain", F.col("weight") * idf(F.col("n"), F.col("df")) * F.col("acc") / (K1 + F.col("acc")))
    matched = F.transform(F.array_sort(F.collect_list(F.struct("ti", "label"))), lambda x: x["label"])
    return part.groupBy("path").agg(F.sum("gain").alias("score"), F.array_join(matched, ",").alias("matched"))


def search(index: Index, terms: list[Term], view: str = "all", scope: str = "", limit: int = 20) -> DataFrame:
    """path, score, matched, rank of the best documents."""
    return ranked(scores(index, terms, view), scope, limit)


def unstemmed(variant: str) -> list[str]:
    """The parts whose stem a variant is: a stem drops s or es, or turns ies into y, so there are few to try."""
    tried = {variant, variant + "s", variant + "es", variant[:-1] + "ies"}
    return sorted(w for w in tried if 2 <= len(w) <= 32 and plain_stem(w) == variant)


def field_counts(units: DataFrame, live: list[Term], fields: tuple[str, ...]) -> DataFrame:
    """path, the length of every field, and how often each variant of each term stands in the fields of a view, as v{term}_{variant}.

    Texts are read once, for the table that this writes; counts need no arrays, as the few parts that give a variant are known.
    """
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = units.select("path", T.spaced(col("path")).alias("x_path"), T.spaced(T.base_name(col("path"))).alias("x_name"), T.spaced(col("sig")).alias("x_sig"), T.spaced(T.body_text(col("body"))).alias("x_body"))
    parts = {"path": ("x_path", "x_name"), "sig": ("x_sig",), "body": ("x_body",)}
    total = lambda f, of: reduce(lambda a, b: a + b, [of(F.col(x)) for x in parts[f]])
    count = lambda f, v: F.least(total(f, lambda x: T.word_count(x, unstemmed(v))), F.lit(T.MAX_TF)).cast("int")
    cols = [F.struct(*[count(f, v).alias(f"tf_{f}") for f in fields]).alias(f"v{i}_{k}") for i, t in enumerate(live) for k, v in enumerate(dict.fromkeys(t.variants))]
    return written(own.select("path", *[total(f, T.token_count).cast("int").alias(f"len_{f}") for f in FIELDS], *cols))


def search_units(units: DataFrame, terms: list[Term], view: str = "all", scope: str = "", limit: int = 20) -> DataFrame:
    """The same without an index: the units are read once, and a narrow table of counts gives the statistics and then the scores."""
    return ranked(unit_scores(units, terms, view), scope, limit)


def unit_scores(units: DataFrame, terms: list[Term], view: str = "all") -> DataFrame:
    live = [t for t in terms if t.weight > 0 and t.variants]
    if not live:
        return units.sparkSession.createDataFrame([], "path string, score double, matched string")
    return counted_scores(field_counts(units, live, VIEWS[view]), live, view)


def counted_scores(narrow: DataFrame, live: list[Term], view: str) -> DataFrame:
    """Scores from a table of ``field_counts``."""
    means = [F.coalesce(F.nullif(F.avg(f"len_{f}"), F.lit(0.0)), F.lit(1.0)).alias(f"avg_{f}") for f in FIELDS]
    some = [F.greatest(F.lit(0), *[F.col(f"v{i}_{k}.tf_{f}") for k in range(len(dict.fromkeys(t.variants))) for f in VIEWS[view]]) for i, t in enumerate(live)]
    stats = narrow.agg(F.count("*").alias("n"), *means, *[F.coalesce(F.sum((s > 0).cast("int")), F.lit(0)).alias(f"d{i}") for i, s in enumerate(some)])
    rows = narrow.where(reduce(lambda a, b: a | b, [s > 0 for s in some])).crossJoin(F.broadcast(stats))  # one row of statistics
    for i, t in enumerate(live):
        parts = []
        for k in range(len(dict.fromkeys(t.variants))):
            parts += [WEIGHT[f] * F.col(f"v{i}_{k}.tf_{f}") / (1 - B[f] + B[f] * F.col(f"len_{f}") / F.col(f"avg_{f}")) for f in VIEWS[view]]
        rows = rows.withColumn(f"a{i}", reduce(lambda a, b: a + b, parts, F.lit(0.0)))
    rows = rows.select("path", "n", *[f"d{i}" for i in range(len(live))], *[f"a{i}" for i in range(len(live))])
    gains = [float(t.weight) * idf(F.col("n"), F.col(f"d{i}")) * F.col(f"a{i}") / (K1 + F.col(f"a{i}")) for i, t in enumerate(live)]
    labels = F.filter(F.array(*[F.when(F.col(f"a{i}") > 0, F.lit(t.label)) for i, t in enumerate(live)]), lambda x: x.isNotNull())
    return rows.select("path", reduce(lambda a, b: a + b, gains, F.lit(0.0)).alias("score"), F.array_join(labels, ",").alias("matched"))


def pool(index: Index, terms: list[Term], scope: str = "", all_: float | None = None, path: float | None = None, sig: float | None = None) -> DataFrame:
    """Top of all fields, then what only the path view and the path+sig view add; scores are of all fields where they exist."""
    return _pool({v: scores(index, terms, v) for v in VIEWS}, scope, all_, path, sig)


def pool_units(units: DataFrame, terms: list[Term], scope: str = "", all_: float | None = None, path: float | None = None, sig: float | None = None) -> DataFrame:
    """The same without an index: one pass over the units."""
    live = [t for t in terms if t.weight > 0 and t.variants]
    if not live:
        return units.sparkSession.createDataFrame([], "path string, score double, matched string, rank int")
    narrow = field_counts(units, live, FIELDS)
    return _pool({v: counted_scores(narrow, live, v) for v in VIEWS}, scope, all_, path, sig)


def _pool(views: dict[str, DataFrame], scope: str, all_: float | None, path: float | None, sig: float | None) -> DataFrame:
    """Only the lanes' rows, some dozens, are ranked, and the scores of all fields are looked up for these."""
    lanes = None
    for lane, (view, limit) in enumerate((("all", cap(all_, POOL_ALL)), ("path", cap(path, POOL_PATH)), ("path+sig", cap(sig, POOL_SIG)))):
        if limit or not lane:
            own = ranked(views[view], scope, limit).select("path", "rank", F.lit(lane).alias("lane"), F.col("score").alias("own"), F.col("matched").alias("own_matched"))
            lanes = own if lanes is None else lanes.unionByName(own)
    first = written(lanes.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("lane"))).where("k = 1").drop("k"))
    late = first.where("lane > 0").select("path")
    whole = best(views["all"].join(F.broadcast(late), "path", "left_semi"), scope, None).select("path", "score", "matched")
    joined = first.join(F.broadcast(whole), "path", "left")
    place = F.row_number().over(Window.orderBy("lane", joined["rank"]))
    return joined.select("path", F.coalesce("score", "own").alias("score"), F.coalesce("matched", "own_matched").alias("matched"), place.cast("int").alias("rank"))


def anchors(hits: DataFrame, top: float | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """dir and hits of the deepest folders that hold several of the best hits (L10); never the root."""
    each = hits.where(F.col("rank") <= cap(top, 10)).select(F.explode(T.ancestors(F.col("path"))).alias("dir"))
    held = each.groupBy("dir").agg(F.count("*").alias("hits")).where(F.col("hits") >= cap(least, 2))
    below = held.select(F.explode(T.ancestors(F.col("dir"))).alias("dir")).distinct()
    return held.join(below, "dir", "left_anti").orderBy(F.desc(F.size(F.split("dir", "/"))), F.desc("hits"), "dir").limit(cap(most, 3))


def line_scores(units: DataFrame, terms: list[Term], df: dict[str, int]) -> DataFrame:
    """path, line (from 1), score and terms of lines that hold query words: each term once, by weight over ln(2 + df)."""
    worth = [(t.label, t.variants, t.weight / math.log(2 + df[t.label])) for t in terms if df.get(t.label, 0) > 0 and t.weight > 0]
    lines = units.select("path", F.posexplode(F.split(F.substring("body", 1, T.MAX_BODY), "\n")).alias("at", "text")).where(F.length("text") <= T.MAX_LINE)
    toks = lines.withColumn("t", T.tokenize(F.col("text")))
    has = [F.arrays_overlap("t", F.array(*[F.lit(v) for v in vs])) for _, vs, _ in worth]
    score = reduce(lambda a, b: a + b, [F.when(h, F.lit(w)).otherwise(0.0) for h, (_, _, w) in zip(has, worth, strict=True)], F.lit(0.0))
    number = reduce(lambda a, b: a + b, [h.cast("int") for h in has], F.lit(0))
    return toks.select("path", (F.col("at") + 1).alias("line"), F.round(score, 6).alias("score"), number.alias("terms")).where("terms > 0")


def evidence(units: DataFrame, terms: list[Term], df: dict[str, int], head: float | None = None, windows: float | None = None, radius: float | None = None, width: int = 140) -> DataFrame:
    """path and shown lines: the first lines, and greedily the windows around the best lines that aren't shown yet.

    The choice of a window depends on those before it, so it is made line by line inside each unit's own array.
    """
    n_head, n_win, rad = cap(head, 8), cap(windows, 3), cap(radius, 2)
    worth = {}
    for i, t in enumerate(terms):
        if df.get(t.label, 0) > 0 and t.weight > 0:
            for v in t.variants:
                worth.setdefault(v, (i, t.weight / math.log(2 + df[t.label])))

    def pick(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, lines, toks in zip(b.path, b.lines, b.toks, strict=True):
                full = [i for i, x in enumerate(lines) if x.strip()]
                keep = set(full[:n_head])
                found = []
                for i, line in enumerate(lines):
                    seen = {worth[t][0]: worth[t][1] for t in reversed(list(toks[i])) if t in worth} if len(line) <= T.MAX_LINE else {}
                    if seen:
                        found.append((-round(sum(seen.values()), 6), -len(seen), i))
                used = 0
                for _, _, i in sorted(found) if n_win else []:
                    if used >= n_win:
                        break
                    if i not in keep:
                        keep.update(range(max(0, i - rad), min(len(lines), i + rad + 1)))
                        used += 1
                out, gap = [], False
                for i in full:
                    if i not in keep:
                        gap = True
                        continue
                    if gap and out:
                        out.append("…")
                    gap = False
                    t = lines[i].rstrip()
                    out.append(f"{i + 1}: {t if len(t) <= width else t[: width - 1] + '…'}")
                rows.append((path, out))
            yield pd.DataFrame(rows, columns=["path", "shown"])

    lines = F.split(F.substring(F.coalesce("body", F.lit("")), 1, T.MAX_BODY), "\n")
    return units.select("path", lines.alias("lines"), F.transform(lines, T.tokenize).alias("toks")).mapInPandas(pick, "path string, shown array<string>")


def grep(units: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """path and how many lines hold any of the words, whatever their case."""
    line = lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(w.lower()) for w in words], F.lit(False))
    return units.select("path", F.size(F.filter(F.split("body", "\n"), line)).alias("lines")).where("lines > 0").orderBy(F.desc("lines"), "path").limit(limit)


def plain_bm25(units: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """BM25 over bodies alone, without stems (L14): k1 1.2, b 0.75."""
    toks = units.select("path", T.plain_words(F.coalesce("body", F.lit(""))).alias("t"))
    rows = toks.select("path", F.size("t").alias("len"), *[F.size(F.filter("t", _equals(w))).alias(f"c{i}") for i, w in enumerate(words)])
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("mean"), *[F.sum((F.col(f"c{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(words))])
    gains = [idf(F.col("n"), F.col(f"d{i}")) * F.col(f"c{i}") * 2.2 / (F.col(f"c{i}") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean"))) for i in range(len(words))]
    scored = rows.where(reduce(lambda a, b: a | b, [F.col(f"c{i}") > 0 for i in range(len(words))])).crossJoin(F.broadcast(stats))
    return scored.select("path", F.round(reduce(lambda a, b: a + b, gains), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def _equals(w: str):
    return lambda x: x == w


def relatives(vocab: DataFrame, words: list[str]) -> DataFrame:
    """Vocabulary of four letters or more in a prefix relation with a typed word of five or more."""
    long = [w for w in words if len(w) >= 5]
    related = reduce(lambda a, b: a | b, [F.col("term").startswith(w) | F.startswith(F.lit(w), F.col("term")) for w in long], F.lit(False))
    return vocab.where((F.length("term") >= 4) & ~F.col("term").isin(*words) & related).select("term", "df")
