"""Judgments of units by an outside scorer, as an interface: a judge adds yes/no scores to rows.

The default is a closed-form offline scorer; ``Replay`` reads a table of recorded judgments. Batches bound what one call holds.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.sources.shared import written

# Fixed values.
BATCH = {"shortlist": 60, "member": 80, "flow": 40, "edges": 100}
FOUND, PARTIAL = 0.7, 0.35
PRICE = 0.042
BLOCKS, SUMMARY, EVIDENCE_DECLS = 96, 0.5, 8


class Judge(Protocol):
    def score(self, rows: DataFrame, stage: str) -> DataFrame:
        """Rows (unit, …) with a column ``belief`` between 0 and 1."""


class Overlap:
    """Share of the question's words that stand in a unit's text."""

    def __init__(self, words: list[str]) -> None:
        self.words = words

    def score(self, rows: DataFrame, stage: str) -> DataFrame:
        hits = [F.lower("text").contains(w.lower()).cast("int") for w in self.words]
        return rows.withColumn("belief", F.round(sum(hits[1:], hits[0]) / len(hits), 6) if hits else F.lit(0.0))


class Replay:
    """Recorded judgments (stage, unit, belief); a unit without one has 0."""

    def __init__(self, judgments: DataFrame) -> None:
        self.judgments = judgments

    def score(self, rows: DataFrame, stage: str) -> DataFrame:
        own = self.judgments.where(F.col("stage") == stage).groupBy("unit").agg(F.max("belief").alias("belief"))
        return rows.join(own, "unit", "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))


class Calls:
    """A judge behind a function of one call: the state of a batch as JSON in, a belief for each of its entries, in order, out.

    Answers that no judge may give, or too few of them, are an error.
    """

    def __init__(self, ask: Callable[[str], list[float]], question: str) -> None:
        self.ask, self.question = ask, question

    def score(self, rows: DataFrame, stage: str) -> DataFrame:
        ask = self.ask

        def call(pdfs):
            import pandas as pd

            for pdf in pdfs:
                yield pd.DataFrame({"bucket": pdf["bucket"], "batch": pdf["batch"], "beliefs": [ask(s) for s in pdf["state"]]})

        own = batches(rows, stage if stage in BATCH else "shortlist", "unit")
        own = own.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "batch").orderBy("unit")))
        answers = states(own, self.question, "unit", ["text"]).mapInPandas(call, "bucket int, batch int, beliefs array<double>")
        got = own.join(answers, ["bucket", "batch"]).withColumn("belief", F.get("beliefs", F.col("place") - 1))
        if invalid(got := written(got)).limit(1).count():
            raise ValueError("a judgment is missing or out of range")
        return got.drop("bucket", "batch", "place", "beliefs")


def batches(rows: DataFrame, stage: str, key: str, buckets: int = 16) -> DataFrame:
    """``bucket`` and ``batch``: the call that a row goes with, of BATCH rows at most.

    Rows are dealt into buckets by hash first, so that no task numbers all of them; only a bucket's last call is not full.
    """
    bucket = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    order = Window.partitionBy("bucket").orderBy(key)
    return rows.withColumn("bucket", bucket).withColumn("batch", F.floor((F.row_number().over(order) - 1) / BATCH[stage]).cast("int"))


def states(rows: DataFrame, question: str, key: str, fields: list[str]) -> DataFrame:
    """(bucket, batch, state): what one call is told, data as JSON in the state and never in a question's text (J12). Columns: bucket, batch."""
    entry = F.to_json(F.struct(key, *fields))
    each = rows.groupBy("bucket", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("e")))), lambda x: x["e"]).alias("entries"))  # BATCH entries at most
    return each.select("bucket", "batch", F.to_json(F.struct(F.lit(question).alias("query"), "entries")).alias("state"))


def verified(beliefs: DataFrame, picks: DataFrame) -> DataFrame:
    """Of each candidate its own belief as score, and the share that a choice among all gave it as pick; ties of score by pick.

    ``beliefs``: path, belief; ``picks``: path, p. What a judge left out has 0.
    """
    p = picks.groupBy("path").agg(F.max("p").alias("pick"))
    rows = beliefs.join(p, "path", "left").select("path", F.coalesce("belief", F.lit(0.0)).alias("score"), F.coalesce("pick", F.lit(0.0)).alias("pick"))
    return rows.orderBy(F.desc("score"), F.desc("pick"), "path")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """A choice among all rows in proportion to a column: what the stand-in gives as pick."""
    total = rows.agg(F.sum(column).alias("all"))
    return rows.crossJoin(F.broadcast(total)).withColumn("p", F.when(F.col("all") > 0, F.col(column) / F.col("all")).otherwise(0.0)).drop("all")


def packed(units: DataFrame, most: int = BLOCKS) -> DataFrame:
    """(path, call): units in order of place, a unit's blocks in one call, a new call where they don't fit (J6). Columns: path, place, blocks.

    The units are those of one chart, so a row's array holds some dozens.
    """
    one = units.agg(F.array_sort(F.collect_list(F.struct("place", "path", F.col("blocks").cast("int").alias("blocks")))).alias("u"))
    start = F.struct(F.lit(0).alias("call"), F.lit(0).alias("held"), F.array().cast("array<struct<path:string,call:int>>").alias("out"))

    def add(a: Column, u: Column) -> Column:
        new = (a["held"] > 0) & (a["held"] + u["blocks"] > most)
        call = a["call"] + new.cast("int")
        return F.struct(call.alias("call"), (F.when(new, 0).otherwise(a["held"]) + u["blocks"]).alias("held"), F.concat(a["out"], F.array(F.struct(u["path"].alias("path"), call.alias("call")))).alias("out"))

    return one.select(F.explode(F.aggregate("u", start, add)["out"]).alias("x")).select("x.path", "x.call")


def summaries(blocks: DataFrame) -> DataFrame:
    """The comment that says best what a unit does, where it is good enough itself (W6). Columns: path, line, kind, score, best (of the
    choice among a unit's comments)."""
    own = blocks.where("kind = 'comment'").groupBy("path").agg(F.max_by(F.struct("line", "score"), F.struct("best", -F.col("line"))).alias("x"))
    return own.where(F.col("x.score") >= SUMMARY).select("path", "x.line", "x.score")


def declarations(decls: DataFrame, terms: DataFrame, most: int = EVIDENCE_DECLS) -> DataFrame:
    """A candidate's declarations that say most about the question (J8): by the worth of the terms in their names, then by line.

    ``decls``: path, name, line; ``terms``: term, worth, ti (forms of one ti count once). The terms are a question's few words.
    """
    each = decls.select("path", "name", "line", F.explode_outer(F.array_distinct(T.tokenize(F.col("name")))).alias("term"))
    hit = each.join(F.broadcast(terms), "term", "left").groupBy("path", "name", "line", "ti").agg(F.max("worth").alias("worth"))
    scored = hit.groupBy("path", "name", "line").agg(F.round(F.coalesce(F.sum("worth"), F.lit(0.0)), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "line", "name"))
    return scored.withColumn("place", place).where(F.col("place") <= most)


def recoverable(status: int | None, timed_out: bool = False) -> bool:
    """Whether a judge's failure leaves the results so far standing: its own time limit, 429, or 5xx."""
    return timed_out or status == 429 or status is not None and 500 <= status < 600


def invalid(judgments: DataFrame) -> DataFrame:
    """Judgments that no judge may give."""
    return judgments.where(~F.coalesce(F.col("belief").between(0, 1), F.lit(False)) | F.isnan("belief"))


def merge_choices(chunks: DataFrame) -> DataFrame:
    """Options judged in several chunks (J4): mean probability of an option, the most of the other answers."""
    return chunks.groupBy("unit", "option").agg(F.avg("p").alias("p"), F.max("under").alias("under"), F.max("confidence").alias("confidence"))


def cost(usage: DataFrame) -> DataFrame:
    return usage.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("input_tokens") / 1e6 * PRICE, 6).alias("usd"))


def verdict(score: Column) -> Column:
    """found, partial or absent (NAV14)."""
    return F.when(score >= FOUND, "found").when(score >= PARTIAL, "partial").otherwise("absent")
