"""Mixing sources to target weights: hierarchical budgets over a domain - language - source tree.

A node's budget goes to its children by their weights. A child takes no more than its subtree can give (the tokens, times the most
epochs, of those of its leaves that have a weight all the way down); what it leaves goes to its siblings by weight, and only when all of them are full has the node itself been given less, so
that the shortage is the ancestors' to pass on. A leaf takes whole epochs and then a prefix, by tokens, of one more epoch; an
epoch's order is the hash of seed, epoch and doc_id.

No window holds a leaf: prefix sums are over buckets of the hash, and only the bucket in which a leaf's prefix ends is sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import WORD, written

LEVELS = ("domain", "lang", "source")
#: About so many documents of one leaf share a bucket of the hash.
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Plan:
    """Weights among siblings by level and name (others 1), the share of all tokens to select, and how often a text may be used."""

    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {"domain": {"src0": 2.0, "src1": 3.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}})
    share: float = 0.9
    epochs: int = 3
    seed: int = 17


def leaf_columns() -> dict[str, Column]:
    """The levels of documents; a domain is a family of sources, their first four characters. Null names are empty ones."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"domain": F.substring(source, 1, 4), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source}


def order_key(plan: Plan, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _weight(plan: Plan, level: str) -> Column:
    out = F.lit(1.0)
    for name, w in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _reachable(plan: Plan) -> Column:
    """Whether no level of a leaf's path has weight 0: below such a node nothing can be given, so it is in no ancestor's cap."""
    out = F.lit(True)
    for level in LEVELS:
        out = out & (_weight(plan, level) > 0)
    return out


def _fill(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Budget of each child from ``given``, its parent's: full children are those that are full before the level of water is reached."""
    order = Window.partitionBy(*parent).orderBy("ratio", level)
    whole = Window.partitionBy(*parent)
    rows = nodes.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
    rows = rows.withColumn("ratio", F.coalesce("ratio", F.lit(float("inf"))))
    rows = rows.withColumn("caps", F.sum("cap").over(order)).withColumn("rest", F.sum("w").over(whole) - F.sum("w").over(order))
    rows = rows.withColumn("full", (F.col("w") > 0) & (F.col("caps") + F.when(F.col("rest") > 1e-12, F.col("ratio") * F.col("rest")).otherwise(0.0) <= F.col("given") + 1e-6))
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole)
    level_up = F.when(open_w > 1e-12, (F.col("given") - taken) / open_w).otherwise(0.0)
    return rows.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(level_up * F.col("w"), F.lit(0.0)))).drop("ratio", "caps", "rest", "full")


def budgets(counted: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, avail, budget) of each leaf of a table with ``n_tokens``. One row a leaf: small beside the documents."""
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").cast("double").alias("avail"))
    leaves = leaves.withColumn("cap", F.when(_reachable(plan), F.col("avail") * float(plan.epochs)).otherwise(0.0))
    above = leaves.agg((F.sum("avail") * plan.share).alias("given")).withColumn("all", F.lit(0))
    keys: list[str] = ["all"]
    out = None
    for i, level in enumerate(LEVELS):
        path = list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("avail").alias("avail")).withColumn("all", F.lit(0)).withColumn("w", _weight(plan, level))
        out = _fill(nodes.join(above, keys), keys, level)
        above = out.select("all", *path, F.col("budget").alias("given"))
        keys = ["all", *path]
    return out.select(*LEVELS, "avail", "budget")


def cutoffs(docs: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Of each leaf: ``whole`` epochs, and ``last``, the greatest order key in the prefix of one more (null: no prefix). And the
    narrow table (doc_id, levels, n_tokens) that was counted."""
    n_tokens = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    counted = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in leaf_columns().items()], n_tokens.alias("n_tokens")))
    leaves = written(
        budgets(counted, plan)
        .withColumn("whole", F.when(F.col("avail") > 0, F.floor(F.col("budget") / F.col("avail") + 1e-9)).otherwise(0).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("avail"))
    )
    digits = max(1, math.ceil(math.log(max(1, counted.count()) / BUCKET_ROWS + 1, 16)))
    keyed = counted.join(leaves.where("rest > 1e-6"), list(LEVELS)).withColumn("key", order_key(plan, F.col("whole"))).withColumn("bucket", F.substring("key", 1, digits))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("n"))
    ends = before.where("before < rest").groupBy(*LEVELS).agg(F.max("bucket").alias("bucket"), F.max("before").alias("before"))
    inside = keyed.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "key", "rest", "before").agg(F.sum("n_tokens").alias("n"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key")) - F.col("n"))
    last = inside.where("upto < rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    return leaves.join(last, list(LEVELS), "left").select(*LEVELS, "whole", "last"), counted


def epochs_of(rows: DataFrame, ends: DataFrame, plan: Plan) -> DataFrame:
    """A row for each (row, epoch) selected; ``rows`` has the levels and doc_id, ``ends`` is what ``cutoffs`` gives."""
    joined = rows.join(ends, list(LEVELS))
    times = F.col("whole") + (F.col("last").isNotNull() & (order_key(plan, F.col("whole")) <= F.col("last"))).cast("int")
    return joined.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1))).drop("whole", "last")


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens: every selected use of a document.

    Tokens are words between ASCII white space; null texts and texts without words have none and go with their place in the order.
    Null names are empty; rows of one doc_id in a leaf share their place and go together; other columns are ignored; an empty table
    gives no rows. Very long texts are counted whole; a weight of 0 takes a node's budget to its siblings, or else to the ancestors'.
    """
    ends, counted = cutoffs(docs, plan)
    return epochs_of(counted, written(ends), plan).select("doc_id", *LEVELS, "epoch", "n_tokens")


def keep_mix(docs: DataFrame, plan: Plan) -> DataFrame:
    """The rows of ``docs`` (its own columns) that the epochs select. Only each leaf's end is joined, so texts are not shuffled as long
    as the leaves' table is below the session's broadcast threshold.

    Null texts have no tokens and go with their place in the order; null names are empty ones; rows without a doc_id share one place in
    their leaf, repeated rows go together; an empty table gives no rows."""
    ends, _ = cutoffs(docs, plan)
    ends = written(ends)
    names = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    place = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*names, F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in leaf_columns().items()])
    return epochs_of(rows, ends, plan).select(*[F.col(p).alias(c) for c, p in place.items()])


def _sql_weight(plan: Plan, level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{n}' THEN {float(w)}" for n, w in plan.weights.get(level, {}).items())
    return f"(CASE {cases} ELSE 1.0 END)" if cases else "1.0"


def sql(plan: Plan = Plan()) -> str:
    """DuckDB SQL for ``mix``: the level of water is found by trying every child's."""
    steps = [
        """d AS (SELECT doc_id, substr(coalesce(source, ''), 1, 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents)""",
        f"""leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS avail,
            CASE WHEN {" AND ".join(f"{_sql_weight(plan, level)} > 0" for level in LEVELS)} THEN sum(n_tokens)::DOUBLE * {plan.epochs} ELSE 0.0 END AS cap FROM d GROUP BY domain, lang, source)""",
        f"b0 AS (SELECT sum(avail) * {plan.share} AS given FROM leaf)",
    ]
    for i, level in enumerate(LEVELS):
        path = ", ".join(LEVELS[: i + 1])
        same = " AND ".join(f"x.{c} = y.{c}" for c in LEVELS[:i]) or "true"
        using = f"JOIN b{i} USING ({', '.join(LEVELS[:i])})" if i else "CROSS JOIN b0"
        steps += [
            f"n{i} AS (SELECT {path}, sum(cap) AS cap, {_sql_weight(plan, level)} AS w FROM leaf GROUP BY {path})",
            f"g{i} AS (SELECT n{i}.*, CASE WHEN w > 0 THEN cap / w END AS unit, given FROM n{i} {using})",
            f"s{i} AS (SELECT x.*, x.w > 0 AND (SELECT sum(least(y.cap, x.unit * y.w)) FROM g{i} y WHERE {same}) <= x.given + 1e-6 AS is_full FROM g{i} x)",
            f"""b{i + 1} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE greatest(0.0, (given - (SELECT coalesce(sum(y.cap), 0) FROM s{i} y WHERE {same} AND y.is_full))
                / (SELECT CASE WHEN sum(y.w) > 0 THEN sum(y.w) END FROM s{i} y WHERE {same} AND NOT y.is_full) * w) END AS given FROM s{i} x)""",
        ]
    steps += [
        "l AS (SELECT *, (CASE WHEN avail > 0 THEN floor(given / avail + 1e-9) ELSE 0 END)::INT AS whole FROM leaf JOIN b3 USING (domain, lang, source))",
        f"k AS (SELECT d.*, whole, given - whole * avail AS rest, md5('{plan.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM d JOIN l USING (domain, lang, source))",
        "c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS before FROM k)",
        "t AS (SELECT *, whole + (CASE WHEN rest > 1e-6 AND before < rest THEN 1 ELSE 0 END) AS times FROM c)",
    ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, domain, lang, source, e.epoch::INT AS epoch, n_tokens FROM t JOIN (SELECT unnest(range(0, {plan.epochs + 1})) AS epoch) e ON e.epoch < t.times"
