"""Find, map and walk: unions of candidates, beams over a hierarchy, losses over an event trace."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.judge import PARTIAL
from sextant.sources.shared import written

# Fixed values.
KEEP_SEMANTIC, KEEP_LEXICAL = 16, 8
MEMBER_ROWS = 80
BEAM, DEPTH, PRUNE = 3, 12, 0.1
STAGES = ("unseen", "unretrieved", "first_hop", "descent", "unverified", "shortlist", "verify", "rank", "hit")


def find_candidates(judged: DataFrame, hits: DataFrame) -> DataFrame:
    """path and place: the best judged, then lexical hits that aren't among them (NAV2)."""
    best = judged.orderBy(F.desc("belief"), "path").limit(KEEP_SEMANTIC).select("path", F.lit(0).alias("lane"), (-F.col("belief")).alias("k"))
    more = hits.join(best.select("path"), "path", "left_anti").orderBy("rank").limit(KEEP_LEXICAL).select("path", F.lit(1).alias("lane"), F.col("rank").cast("double").alias("k"))
    return best.unionByName(more).withColumn("place", F.row_number().over(Window.orderBy("lane", "k", "path"))).select("path", "lane", "place")


def map_results(judged: DataFrame) -> DataFrame:
    """Members: judged half-way or better, the best rows (NAV13)."""
    return judged.where(F.col("belief") >= PARTIAL).orderBy(F.desc("belief"), "path").limit(MEMBER_ROWS)


def merge_verified(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second judgment of a path replaces the first (NAV4)."""
    return second.unionByName(first.join(second, "path", "left_anti")).orderBy(F.desc("score"), F.desc("pick"), "path")


def clean_params(beam: float | None = None, depth: float | None = None, scope: str = "") -> tuple[int, int, str]:
    """Beam 1 to 10, depth 1 to 30, scope without outer slashes (NAV15)."""
    clamp = lambda x, low, high, default: default if x is None or x != x else int(max(low, min(high, x)))
    return clamp(beam, 1, 10, BEAM), clamp(depth, 1, 30, DEPTH), scope.strip("/")


def strategy(question: str, selected: str | None = None) -> str:
    """An explicit choice wins; questions for a way through are explained, others found (NAV19)."""
    if selected:
        return selected
    return "explain" if re.search(r"^\s*(how|explain|trace)\b|\bflow\b|walk me through", question, re.I) else "find"


def strategy_of(question: Column) -> Column:
    """The same for a column of questions without a choice (NAV19)."""
    return F.when(question.rlike(r"(?i)^\s*(how|explain|trace)\b|\bflow\b|walk me through"), "explain").otherwise("find")


def walk(children: DataFrame, beam: int = BEAM, depth: int = DEPTH) -> DataFrame:
    """Beam search from the root (NAV8, NAV9): path, kind, score, step of what remains.

    ``children``: parent, path, kind, p (probability among its siblings), under (that the answer is below the parent). A path's
    score is the geometric mean of its probabilities. Folders below PRUNE are left; finished files stay and compete. A round is one
    join of at most ``beam`` rows, which are written so that plans don't grow.
    """
    pool = children.sparkSession.createDataFrame([("", "dir", 1.0, 0, 1.0, 0)], "path string, kind string, product double, decisions int, score double, step int")
    for step in range(1, depth + 1):
        opened = pool.where("kind = 'dir'")
        if not opened.limit(1).count():
            break
        down = opened.select(F.col("path").alias("parent"), "product", "decisions").join(children, "parent").where((F.col("parent") == "") | (F.col("under") >= PRUNE))
        product, n = F.col("product") * F.col("p"), F.col("decisions") + 1
        score = F.when(product > 0, F.exp(F.log(product) / n)).otherwise(0.0)
        grown = down.select("path", "kind", product.alias("product"), n.alias("decisions"), F.round(score, 6).alias("score"), F.lit(step).alias("step"))
        pool = written(pool.where("kind = 'file'").unionByName(grown).orderBy(F.desc("score"), "path").limit(beam))
    return pool.select("path", "kind", "score", "step")


def backtracks(leaders: DataFrame) -> DataFrame:
    """Steps at which the leader is neither the one before nor below it (NAV10). Columns: run, step, path."""
    last = F.lag("path").over(Window.partitionBy("run").orderBy("step"))
    rows = leaders.withColumn("last", last)
    return rows.where(F.col("last").isNotNull() & (F.col("path") != F.col("last")) & ~F.col("path").startswith(F.concat("last", F.lit("/")))).select("run", "step", F.col("last").alias("from_path"), F.col("path").alias("to_path"))


def separation(finished: DataFrame) -> DataFrame:
    """Best over second score of each run (NAV11); null with fewer than two."""
    two = F.slice(F.sort_array(F.collect_list("score"), False), 1, 2)
    return finished.groupBy("run").agg(F.when(F.size(two) == 2, F.round(F.get(two, 0) / F.nullif(F.get(two, 1), F.lit(0.0)), 6)).alias("separation"))


def stage_order(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)


def attribute_loss(losses: DataFrame) -> DataFrame:
    """Of each run: the accepted path that came furthest (NAV17). Columns: run, path, stage, child_p."""
    key = F.struct(stage_order(F.col("stage")).alias("s"), F.coalesce("child_p", F.lit(0.0)).alias("p"), F.col("path"))
    return losses.groupBy("run").agg(F.max_by(F.struct("path", "stage"), key).alias("x")).select("run", "x.path", "x.stage")
