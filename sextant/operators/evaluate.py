"""Retrieval evaluation: metrics of ranked lists, summaries, agreement of runs, seeded samples and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 10


def metrics(tasks: DataFrame, runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Of each task: hit@1/5/10, recall@5/10, MRR@10 and nDCG@10.

    A path counts once in a list, at its best rank; a task without a list has zeros; one without relevant paths too.
    """
    first = runs.groupBy("task", "path").agg(F.min("rank").alias("r"))
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy("r", "path"))).where(F.col("rank") <= DEPTH)
    gold = qrels.select("task", "path").distinct()
    hits = placed.join(gold, ["task", "path"], "left_semi").groupBy("task").agg(
        F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("in5"), F.count("*").alias("in10"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    sizes = gold.groupBy("task").agg(F.count("*").alias("size"))
    rows = tasks.select("task").distinct().join(sizes, "task", "left").join(hits, "task", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("size", F.lit(DEPTH)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    got = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "task",
        *[F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"hit{k}") for k in (1, 5, 10)],
        F.round(got(F.col("in5") / F.col("size")), 6).alias("recall5"),
        F.round(got(F.col("in10") / F.col("size")), 6).alias("recall10"),
        F.round(got(1 / F.col("first")), 6).alias("mrr10"),
        F.round(got(F.col("dcg") / ideal), 6).alias("ndcg10"),
    )


def place_value(rows: DataFrame, keys: list[str], column: str, share: float) -> DataFrame:
    """Of each group: the value at place floor(n * share) of its sorted values, the last at most."""
    order = Window.partitionBy(*keys).orderBy(column)
    ranked = rows.select(*keys, column, F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    return ranked.where(F.col("k") == F.least(F.col("n"), F.floor(F.col("n") * share) + 1)).select(*keys, F.col(column).alias("value"))


def summary(results: DataFrame, keys: list[str], latency: str = "ms") -> DataFrame:
    """Means of the metrics and p50/p95 latency of each group (E2); a failed row has null metrics and counts as zero."""
    names = [c for c in results.columns if c.startswith(("hit", "recall", "mrr", "ndcg"))]
    means = results.groupBy(*keys).agg(F.count("*").alias("tasks"), *[F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6).alias(c) for c in names])
    for share, name in ((0.5, "p50"), (0.95, "p95")):
        means = means.join(place_value(results, keys, latency, share).withColumnRenamed("value", name), keys)
    return means


def jaccard(a: Column, b: Column) -> Column:
    """Agreement of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of least SHA-256 of seed and key: the same whatever the order of the rows."""
    return rows.withColumn("order", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).orderBy("order", key).limit(n).drop("order")


def flow_score(flows: DataFrame) -> DataFrame:
    """Of each chart: shares of must and should nodes drawn, forbidden nodes drawn, must edges drawn in either direction, and edges
    beyond the graph (E5). Columns: id, nodes, must, should, must_not array<string>; edges, must_edges, known_edges
    array<array<string>>."""
    either = lambda e, c: F.exists(c, lambda x: (x == e) | (F.reverse(x) == e))
    share = lambda part, whole: F.when(F.size(whole) == 0, F.lit(1.0)).otherwise(part / F.size(whole))
    both = lambda c: F.size(F.array_intersect("nodes", c))
    return flows.select(
        "id", share(both("must"), F.col("must")).alias("must"), share(both("should"), F.col("should")).alias("should"), both("must_not").alias("forbidden"),
        share(F.size(F.filter("must_edges", lambda e: either(e, F.col("edges")))), F.col("must_edges")).alias("must_edges"), F.size(F.filter("edges", lambda e: ~either(e, F.col("known_edges")))).alias("invented"),
    )


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many distinct rows there are, and a digest of them as a set (E8): sums of two halves of their hashes, so that
    partial sums meet and no task holds the rows."""
    text = F.concat(*[F.concat(F.coalesce(F.length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    each = rows.select(F.sha2(text, 256).alias("h")).distinct()
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return each.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("/", part(1), part(16)), 256).alias("digest"))


def recalls(ranked: DataFrame, relevant: DataFrame, at: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Means over tasks of hit and recall at each depth (E3). ``ranked``: task, path, rank; ``relevant``: task, path."""
    size = relevant.groupBy("task").agg(F.count("*").alias("size"))
    own = ranked.join(relevant, ["task", "path"], "left_semi").groupBy("task").agg(*[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in at])
    rows = size.join(own, "task", "left").fillna(0)
    return rows.agg(F.count("*").alias("tasks"), *[F.round(F.avg((F.col(f"n{k}") > 0).cast("int")), 6).alias(f"hit{k}") for k in at], *[F.round(F.avg(F.col(f"n{k}") / F.col("size")), 6).alias(f"recall{k}") for k in at])


def score_rows(results: DataFrame, k: int = 10) -> DataFrame:
    """Of each task and strategy: hit@1 and hit@k (E4). Columns: task, strategy, ranked, accept array<string>.

    A task without accepted paths is a hit when nothing is returned.
    """
    nothing = F.size("accept") == 0
    hit = lambda n: F.when(nothing, F.size("ranked") == 0).otherwise(F.arrays_overlap(F.slice("ranked", 1, n), "accept"))
    return results.select("task", "strategy", hit(1).cast("int").alias("hit1"), hit(k).cast("int").alias(f"hit{k}"))


def loss_histogram(losses: DataFrame) -> DataFrame:
    """strategy and a map from the stage at which an answer was lost to how many were (E4). Columns: strategy, stage."""
    counts = losses.groupBy("strategy", "stage").agg(F.count("*").alias("n"))
    return counts.groupBy("strategy").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("lost"))


def stage_ranks(trace: DataFrame, accept: DataFrame) -> DataFrame:
    """Of each task and stage of a trace: the best rank of an accepted path, null where none got there.

    ``trace``: task, stage, path, score; ``accept``: task, path.
    """
    ranked = trace.withColumn("rank", F.row_number().over(Window.partitionBy("task", "stage").orderBy(F.desc("score"), "path")))
    own = ranked.join(accept.select("task", "path").withColumn("ok", F.lit(True)), ["task", "path"], "left")
    return own.groupBy("task", "stage").agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("rank"))
