"""Registered queries of judge batteries, navigation, charts, evaluation and ledgers beyond the first set, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import Duck
from sextant.operators import dense as D
from sextant.operators import evaluate as E
from sextant.operators import flow as W
from sextant.operators import graph as X
from sextant.operators import judge as J
from sextant.operators import navigate as N
from sextant.plans import evaluation
from sextant.plans.structure import judged, uses
from sextant.sources import snapshot as S
from sextant.sources.tables import table, units
from sextant.streaming import ledger as R


def _beliefs(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("path", F.col("value").alias("belief"))


def judge_batches(spark: SparkSession, sf: str) -> DataFrame:
    return J.batches(_beliefs(spark, sf).select("path"), "shortlist", "path").groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def judge_states(spark: SparkSession, sf: str) -> DataFrame:
    own = units(spark, sf).select("path", F.substring("sig", 1, 20).alias("hint"))
    return J.states(J.batches(own, "member", "path"), "where are the things", "path", ["hint"]).select("bucket", "batch", F.md5("state").alias("state"))


def invalid_judgments(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.lit(None)).when(F.col("s_suppkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal") / 9000).alias("belief"))
    return J.invalid(own).select("s_suppkey")


def merged_choices(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("option"), F.col("l_discount").alias("p"), F.col("l_tax").alias("under"), F.col("l_quantity").alias("confidence"))
    return J.merge_choices(own).withColumn("p", F.round("p", 6))


def judge_cost(spark: SparkSession, sf: str) -> DataFrame:
    return J.cost(table(spark, sf, "orders").select(F.col("o_custkey").alias("input_tokens"), (F.col("o_orderkey") % 5).alias("output_tokens")))


def verified_candidates(spark: SparkSession, sf: str) -> DataFrame:
    few = table(spark, sf, "supplier").select(F.col("s_name").alias("path"), (F.col("s_nationkey") % 4 / 4).alias("belief"))
    picks = J.shares(table(spark, sf, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_name").alias("path"), F.col("s_nationkey").cast("double").alias("w")), "w").select("path", "p")
    return J.verified(few, picks).withColumn("pick", F.round("pick", 9))


def merged_verified(spark: SparkSession, sf: str) -> DataFrame:
    all_ = table(spark, sf, "supplier").select(F.col("s_name").alias("path"), (F.col("s_nationkey") / 25).alias("score"), F.lit(0.0).alias("pick"), "s_suppkey")
    second = all_.where("s_suppkey % 4 = 1").select("path", (F.col("score") / 2).alias("score"), F.lit(0.5).alias("pick"))
    return N.merge_verified(all_.drop("s_suppkey"), second).withColumn("score", F.round("score", 6))


def block_calls(spark: SparkSession, sf: str) -> DataFrame:
    few = table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("path"), (F.col("n_nationkey") * 37 % 60 + 1).alias("blocks"))
    return J.packed(few)


def unit_summaries(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.when(F.col("l_returnflag") == "N", "comment").otherwise("code").alias("kind"), (F.col("l_discount") * 10).alias("score"), F.col("l_tax").alias("best"))
    return J.summaries(own)


def candidate_declarations(spark: SparkSession, sf: str) -> DataFrame:
    decls = table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.initcap(F.col("p_type"))).alias("name"), F.col("p_partkey").alias("line"))
    return J.declarations(decls, spark.createDataFrame([("widget", 0.5, 0), ("large", 0.25, 1), ("promo", 0.125, 2)], "term string, worth double, ti int"))


def step_separation(spark: SparkSession, sf: str) -> DataFrame:
    return N.separation(table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_totalprice").alias("score")))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(s(k).alias("from"), s((k * 7 + 3) % 90).alias("to"), (k % 5 == 0).alias("type_only"), (k % 9).alias("line"), F.array_repeat(F.lit("n"), (k % 6).cast("int")).alias("names"))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), (F.col("s_suppkey") * 11 % 97).alias("place"))


def flow_expansion(spark: SparkSession, sf: str) -> DataFrame:
    places = _places(spark, sf)
    return W.expand(places.where("place < 12"), _pairs(spark, sf), places.where("place < 30").select("path"), 2)


def flow_terminals(spark: SparkSession, sf: str) -> DataFrame:
    own = X.degrees(uses(spark, sf).select("from", "to")).select("node", "fan_in", (F.col("fan_out") % 10 / 10).alias("plumbing"))
    return W.terminal(own, F.lit(20)).select("node", "terminal")


def flow_mentions(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "supplier").select(F.concat_ws("/", F.lit("x"), F.substring("s_name", 10, 20), F.when(F.col("s_suppkey") % 4 == 0, "same-name.ts").otherwise(F.concat(F.col("s_suppkey").cast("string"), F.lit("-unit.ts")))).alias("path"))
    about = table(spark, sf, "customer").where("c_custkey < 60").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("see "), F.col("c_custkey").cast("string"), F.lit("-unit.ts and same-name.ts")).alias("about"))
    edges = spark.createDataFrame([("c1", "x/000000001/1-unit.ts")], "from string, to string")
    return W.mentions(about, names, edges)


def flow_back_edges(spark: SparkSession, sf: str) -> DataFrame:
    return W.back_edges(_pairs(spark, sf).select("from", "to"), _places(spark, sf))


def flow_evidence(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), (F.col("l_discount") * 10).alias("score"))
    return W.node_evidence(own).withColumn("lines", F.array_join("lines", ","))


def flow_summary(spark: SparkSession, sf: str) -> DataFrame:
    nodes = W.cut_nodes(evaluation._parts(spark, sf))
    return W.chart_summary(nodes, evaluation.flow_edges(spark, sf), 500, 600)


def flow_roles(spark: SparkSession, sf: str) -> DataFrame:
    word = F.get(F.array(*map(F.lit, ("auth", "db", "Page", "sdk", "main", "router", "util", "UserStore", "specFile"))), (F.col("p_partkey") % 9).cast("int"))
    own = W.roles(table(spark, sf, "part").select("p_partkey", F.concat(F.lit("lib/"), F.col("p_type"), F.lit("/"), word, F.lit(".ts")).alias("path")))
    return own.select("p_partkey", "role", "role_confidence", W.role_rank(F.col("role")).alias("rank"))


def flow_carries(spark: SparkSession, sf: str) -> DataFrame:
    return W.carries(_pairs(spark, sf)).select("from", "to", F.round("carries", 6).alias("carries"))


def edge_classes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "nation")
    return e.select("n_name", W.edge_class(F.col("n_nationkey") % 4, F.col("n_regionkey")).alias("drawn"))


def comment_summaries(spark: SparkSession, sf: str) -> DataFrame:
    block = F.array(F.concat(F.col("p_name"), F.lit(" holds. It is "), F.col("p_type")), F.lit("more."), F.lit("→ int x;"))
    return table(spark, sf, "part").select("p_partkey", W.summary_text(block).alias("summary"))


def comment_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Of texts made of parts: a line comment, a divider, code, a block comment and code, with the marks of their kind."""
    ext = F.get(F.array(*map(F.lit, ("ts", "py", "sql"))), (F.col("p_partkey") % 3).cast("int"))
    mark = F.get(F.array(*map(F.lit, ("//", "#", "--"))), (F.col("p_partkey") % 3).cast("int"))
    body = F.concat(mark, F.lit(" "), F.col("p_name"), F.lit("\n"), mark, F.lit(" TODO later\n"), mark, F.lit(" ends here\nrun("), F.col("p_size").cast("string"), F.lit(")\n\n/* "), F.col("p_type"), F.lit("\n * goes on */\nlast()\n"), mark, F.lit(" import x\n"))
    return W.comment_blocks(table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"), body.alias("body"))).select("path", "line", F.array_join("text", "|").alias("text"))


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("ranked"))
    accept = F.when(F.col("o_custkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    return E.score_rows(o.select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("strategy"), "ranked", accept.alias("accept")), 3)


def loss_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = E.loss_histogram(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("strategy"), F.col("o_orderpriority").alias("stage")))
    return own.select("strategy", F.explode("lost").alias("stage", "n"))


def stage_ranks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("stage"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("path"), F.col("l_quantity").alias("score"))
    accept = table(spark, sf, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("task"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("path"))
    return E.stage_ranks(t, accept).withColumn("rank", F.coalesce("rank", F.lit(0)))


def recall_depths(spark: SparkSession, sf: str) -> DataFrame:
    _, runs, qrels = evaluation._run(spark, sf)
    return E.recalls(runs, qrels, (1, 5, 10))


def flow_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Charts of orders: nodes are the suppliers of their lines, edges lead from the lower to the higher."""
    o = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("nodes"), F.min("l_suppkey").cast("string").alias("a"), F.max("l_suppkey").cast("string").alias("b"))
    e = lambda x, y: F.array(F.array(x, y))
    return E.flow_score(o.select("id", "nodes", F.array("a", F.lit("none")).alias("must"), F.array().cast("array<string>").alias("should"), F.array("b").alias("must_not"), e(F.col("a"), F.col("b")).alias("edges"), F.when(F.col("id") % 2 == 0, e(F.col("b"), F.col("a"))).otherwise(e(F.lit("x"), F.lit("y"))).alias("must_edges"), F.when(F.col("id") % 3 == 0, e(F.col("a"), F.col("b"))).otherwise(e(F.lit("x"), F.lit("y"))).alias("known_edges")))


def row_digests(spark: SparkSession, sf: str) -> DataFrame:
    return E.digest(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_custkey")), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def vector_faults(spark: SparkSession, sf: str) -> DataFrame:
    chunks, queries = evaluation.vectors(spark, sf)
    bad = chunks.select(F.when(F.col("file") % 9 == 0, F.slice("embedding", 1, 3)).when(F.col("file") % 7 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")).alias("embedding"))
    return D.input_faults(bad, queries.unionByName(queries.where("query < 3")), 64)


def trace_faults(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("seq") % 50 == 0, "done").when(F.col("type") == "error", "error").when(F.col("type") == "view", "pool").when(F.col("type") == "click", "verify").otherwise(F.col("type"))
    return R.trace_faults(evaluation.trace(spark, sf).select("run", "seq", kind.alias("type")))


def answer_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", R.answer_identity(F.col("n_name").alias("question"), F.lit("find").alias("mode")).alias("identity"))


def admission_ladder(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("identity"), F.col("event_type").alias("key"), (F.col("event_id") % 10 == 0).alias("cached"), (F.col("value") * 10).alias("seconds"))
    return R.ladder(e)


def patch_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Of patches made of parts: one changes a file, one renames it, one adds it, one changes a test."""
    k, name = F.col("p_partkey"), F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".py"))
    old = F.when(k % 4 == 3, F.concat(F.lit("tests/test_"), k.cast("string"), F.lit(".py"))).otherwise(name)
    head = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), old, F.lit("\n"))
    plain = F.concat(head, F.lit("--- a/"), old, F.lit("\n+++ b/"), old, F.lit("\n@@ -1 +1 @@\n-a\n+b\n"))
    moved = F.concat(head, F.lit("rename from "), old, F.lit("\nrename to new.py\n"))
    added = F.concat(head, F.lit("new file mode 100644\n--- /dev/null\n+++ b/"), old, F.lit("\n"))
    patches = table(spark, sf, "part").select(k.cast("string").alias("task"), F.when(k % 4 == 1, moved).when(k % 4 == 2, added).otherwise(plain).alias("patch"))
    return S.relevant_paths(patches, table(spark, sf, "part").where("p_partkey % 5 > 0").select(k.cast("string").alias("task"), old.alias("path")))


QUERIES = {
    f.__name__: f
    for f in (
        judge_batches, judge_states, invalid_judgments, merged_choices, judge_cost, verified_candidates, merged_verified, block_calls, unit_summaries, candidate_declarations, step_separation, flow_expansion, flow_terminals, flow_mentions,
        flow_back_edges, flow_evidence, flow_summary, flow_roles, flow_carries, edge_classes, comment_summaries, comment_blocks, scored_rows, loss_counts, stage_ranks, recall_depths, flow_scores, row_digests, vector_faults, trace_faults,
        answer_keys, admission_ladder, patch_gold,
    )
}

_BATCH = "row_number() OVER (PARTITION BY bucket ORDER BY path)"
_BUCKETS = "(('0x' || substr(md5(path), 1, 8))::BIGINT % 16)::INT"
_LINE = "l_suppkey AS path, l_orderkey * 10 + l_linenumber AS line"
_PAIRS = "e AS (SELECT 's' || s_suppkey AS a, 's' || ((s_suppkey * 7 + 3) % 90) AS b, s_suppkey % 5 = 0 AS type_only, s_suppkey % 9 AS line, s_suppkey FROM supplier), p AS (SELECT 's' || s_suppkey AS path, s_suppkey * 11 % 97 AS place FROM supplier)"
_ROLES = {"auth": "guard", "db": "persistence", "Page": "ui", "sdk": "client", "main": "entrypoint", "router": "handler", "util": None, "UserStore": "persistence", "specFile": "test"}
_ROLE_ROWS = ", ".join(f"({i}, '{r or 'service'}', {0.6 if r else 0.3}::DOUBLE, {W.ROLES.index(r or 'service')})" for i, r in enumerate(_ROLES.values()))
_TRACE = ", ".join(f"'{t}'" for t in R.TRACE)

SQL = {
    "judge_batches": f"""WITH {evaluation._JUDGED}, k AS (SELECT path, {_BUCKETS} AS bucket FROM j), b AS (SELECT *, (({_BATCH} - 1) // 60)::INT AS batch FROM k)
        SELECT bucket, batch, count(*) AS n, min(path) AS first FROM b GROUP BY bucket, batch""",
    "judge_states": f"""WITH {Duck.units()}, k AS (SELECT path, substr(sig, 1, 20) AS hint, {_BUCKETS} AS bucket FROM units), b AS (SELECT *, (({_BATCH} - 1) // 80)::INT AS batch FROM k),
        e AS (SELECT *, '{{"path":"' || path || '","hint":"' || replace(replace(hint, '\\', '\\\\'), '"', '\\"') || '"}}' AS e FROM b)
        SELECT bucket, batch, md5('{{"query":"where are the things","entries":[' || string_agg('"' || replace(replace(e, '\\', '\\\\'), '"', '\\"') || '"', ',' ORDER BY path) || ']}}') AS state FROM e GROUP BY bucket, batch""",
    "invalid_judgments": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 OR NOT (s_acctbal / 9000 BETWEEN 0 AND 1)",
    "merged_choices": "SELECT l_suppkey AS unit, l_returnflag AS option, round(avg(l_discount), 6) AS p, max(l_tax) AS under, max(l_quantity) AS confidence FROM lineitem GROUP BY ALL",
    "judge_cost": f"SELECT sum(o_custkey)::BIGINT AS input_tokens, sum(o_orderkey % 5)::BIGINT AS output_tokens, round(sum(o_custkey) / 1e6 * {J.PRICE}, 6)::DOUBLE AS usd FROM orders",
    "verified_candidates": """WITH p AS (SELECT s_name, s_nationkey / sum(s_nationkey) OVER () AS p FROM supplier WHERE s_suppkey % 3 > 0)
        SELECT s_name AS path, (s_nationkey % 4 / 4)::DOUBLE AS score, round(coalesce(p, 0)::DOUBLE, 9) AS pick FROM supplier LEFT JOIN p USING (s_name)""",
    "merged_verified": "SELECT s_name AS path, round((s_nationkey / 25 / (CASE WHEN s_suppkey % 4 = 1 THEN 2 ELSE 1 END))::DOUBLE, 6) AS score, (CASE WHEN s_suppkey % 4 = 1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS pick FROM supplier",
    "block_calls": f"""WITH RECURSIVE u AS (SELECT n_nationkey AS k, n_name AS path, n_nationkey * 37 % 60 + 1 AS b FROM nation),
        r AS (SELECT k, path, b AS held, 0 AS call FROM u WHERE k = 0 UNION ALL SELECT u.k, u.path, CASE WHEN held + u.b > {J.BLOCKS} THEN u.b ELSE held + u.b END, call + (CASE WHEN held + u.b > {J.BLOCKS} THEN 1 ELSE 0 END) FROM r JOIN u ON u.k = r.k + 1)
        SELECT path, call FROM r""",
    "unit_summaries": f"""WITH c AS (SELECT {_LINE}, l_discount * 10 AS score, l_tax AS best FROM lineitem WHERE l_returnflag = 'N'), w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY best DESC, line) = 1)
        SELECT path, line, score FROM w WHERE score >= {J.SUMMARY}""",
    "candidate_declarations": f"""WITH d AS (SELECT p_brand AS path, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, p_partkey AS line FROM part),
        t AS (SELECT *, {Duck.tokenize('name')} AS t FROM d), s AS (SELECT path, name, line, round(0.5 * list_contains(t, 'widget')::INT + 0.25 * list_contains(t, 'large')::INT + 0.125 * list_contains(t, 'promo')::INT, 6)::DOUBLE AS score FROM t)
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, line, name)::INT AS place FROM s QUALIFY place <= {J.EVIDENCE_DECLS}""",
    "step_separation": """WITH r AS (SELECT o_custkey AS run, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS k FROM orders)
        SELECT run, round(max(s) FILTER (k = 1) / max(s) FILTER (k = 2), 6) AS separation FROM r GROUP BY run""",
    "flow_expansion": f"""WITH {_PAIRS}, x AS (SELECT a, b, line FROM e WHERE NOT type_only UNION ALL SELECT b, a, line FROM e WHERE NOT type_only), n AS (SELECT x.*, place FROM x JOIN p ON p.path = a AND place < 12 WHERE b NOT IN (SELECT path FROM p WHERE place < 30)),
        f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY b ORDER BY place, line, a) = 1)
        SELECT b AS path, a AS claimed_by FROM f QUALIFY row_number() OVER (PARTITION BY a ORDER BY line, b) <= 2""",
    "flow_terminals": """WITH u AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), n AS (SELECT b AS node, 1 AS i, 0 AS o FROM u UNION ALL SELECT a, 0, 1 FROM u)
        SELECT node, sum(i) > 20 OR sum(o) % 10 / 10 >= 0.6 AS terminal FROM n GROUP BY node""",
    "flow_mentions": """WITH n AS (SELECT 'x/' || substr(s_name, 10, 20) || '/' || s_suppkey || '-unit.ts' AS path, s_suppkey FROM supplier WHERE s_suppkey % 4 > 0 AND length(s_suppkey || '-unit.ts') >= 8)
        SELECT 'c' || c_custkey AS "from", path AS "to" FROM customer JOIN n ON contains('see ' || c_custkey || '-unit.ts and same-name.ts', s_suppkey || '-unit.ts') WHERE c_custkey < 60 AND NOT (c_custkey = 1 AND s_suppkey = 1)""",
    "flow_back_edges": f"""WITH {_PAIRS} SELECT a AS "from", b AS "to", x.place > y.place AS back FROM e JOIN p x ON x.path = a JOIN p y ON y.path = b""",
    "flow_evidence": f"""WITH c AS (SELECT {_LINE}, l_discount * 10 AS score FROM lineitem WHERE l_discount * 10 >= {W.EVIDENCE_LEAST}), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, line) <= {W.EVIDENCE})
        SELECT path, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM k GROUP BY path""",
    "flow_summary": f"""WITH f AS ({evaluation.SQL["flow_edges"]}), n AS ({evaluation.SQL["flow_nodes"]}), b AS (SELECT max(s_suppkey % 13 / 12) AS best FROM supplier JOIN n ON path = 's' || s_suppkey)
        SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM f) AS edges, 500 - (SELECT count(*) FROM n) AS dropped_nodes, 600 - (SELECT count(*) FROM f) AS dropped_edges, CASE WHEN best >= 0.7 AND (SELECT count(*) FROM f) > 0 THEN 'found' ELSE 'partial' END AS verdict FROM b""",
    "flow_roles": f"SELECT p_partkey, role, c AS role_confidence, r AS rank FROM part JOIN (VALUES {_ROLE_ROWS}) v(k, role, c, r) ON k = p_partkey % 9",
    "flow_carries": f"""WITH {_PAIRS} SELECT a AS "from", b AS "to", round((CASE WHEN type_only THEN 0.2 ELSE least(1.0, 0.4 + 0.15 * (s_suppkey % 6)) END)::DOUBLE, 6) AS carries FROM e""",
    "edge_classes": "SELECT n_name, CASE WHEN n_regionkey > n_nationkey % 4 THEN 'routed' WHEN n_regionkey = n_nationkey % 4 THEN 'side' ELSE 'floor' END AS drawn FROM nation",
    "comment_summaries": "SELECT p_partkey, p_name || ' holds.' AS summary FROM part",
    "comment_blocks": """WITH p AS (SELECT p_partkey || '.' || ['ts', 'py', 'sql'][p_partkey % 3 + 1] AS path, p_partkey % 3 = 0 AS ts, * FROM part)
        SELECT path, 1 AS line, p_name || '|ends here|→ run(' || p_size || ')' AS text FROM p UNION ALL SELECT path, 6, p_type || '|goes on|→ last()' FROM p WHERE ts""",
    "scored_rows": """WITH r AS (SELECT o_custkey AS task, o_orderstatus AS strategy, list(o_orderpriority ORDER BY o_orderkey) AS r FROM orders GROUP BY ALL)
        SELECT task, strategy, (CASE WHEN task % 5 = 0 THEN len(r) = 0 ELSE list_has_any(r[1:1], ['1-URGENT', '5-LOW']) END)::INT AS hit1, (CASE WHEN task % 5 = 0 THEN len(r) = 0 ELSE list_has_any(r[1:3], ['1-URGENT', '5-LOW']) END)::INT AS hit3 FROM r""",
    "loss_counts": "SELECT o_orderstatus AS strategy, o_orderpriority AS stage, count(*) AS n FROM orders GROUP BY ALL",
    "stage_ranks": """WITH t AS (SELECT l_orderkey AS task, l_returnflag AS stage, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS path, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_partkey || '-' || l_suppkey || '-' || l_linenumber) AS rank, bool_or(l_discount > 0.05) OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS ok FROM lineitem)
        SELECT task, stage, coalesce(min(rank) FILTER (ok), 0)::INT AS rank FROM t GROUP BY task, stage""",
    "recall_depths": f"""WITH {evaluation._TOP}, s AS (SELECT label AS task, count(*) AS size FROM embeddings GROUP BY label),
        n AS (SELECT r.query AS task, {", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}" for k in (1, 5, 10))} FROM r JOIN embeddings e ON e.label = r.query AND e.vec_id = r.file GROUP BY 1)
        SELECT count(*) AS tasks, {", ".join(f"round(avg((coalesce(n{k}, 0) > 0)::INT), 6) AS hit{k}, round(avg(coalesce(n{k}, 0) / size), 6) AS recall{k}" for k in (1, 5, 10))} FROM s LEFT JOIN n USING (task)""",
    "flow_scores": """WITH o AS (SELECT l_orderkey AS id, min(l_suppkey)::VARCHAR AS a, max(l_suppkey)::VARCHAR AS b FROM lineitem GROUP BY 1)
        SELECT id, 0.5::DOUBLE AS must, 1.0::DOUBLE AS should, 1 AS forbidden, (CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS must_edges, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS invented FROM o""",
    "row_digests": """WITH d AS (SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b, o_custkey::VARCHAR AS c FROM orders), h AS (SELECT sha256(length(a) || ':' || a || length(b) || ':' || b || length(c) || ':' || c) AS h FROM d)
        SELECT count(*) AS rows, sha256(sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || '/' || sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR) AS digest FROM h""",
    "vector_faults": """WITH q AS (SELECT DISTINCT label FROM embeddings) SELECT * FROM (VALUES ('another size', (SELECT count(*) FROM embeddings WHERE vec_id % 9 = 0)), ('no length', (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 9 > 0)),
        ('not a number', 0), ('repeated queries', (SELECT count(*) FROM q WHERE label < 3))) t(fault, n)""",
    "trace_faults": f"""WITH t AS (SELECT user_id AS run, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'done' WHEN event_type = 'view' THEN 'pool' WHEN event_type = 'click' THEN 'verify' ELSE event_type END AS type FROM events),
        r AS (SELECT run, arg_min(type, seq) AS first, max(seq) - min(seq) + 1 <> count(*) AS gap, bool_or(type NOT IN ({_TRACE})) AS unknown, min(seq) FILTER (type IN ('done', 'error')) AS stop, max(seq) AS last FROM t GROUP BY run)
        SELECT * FROM (VALUES ('no start', (SELECT count(*) FROM r WHERE first <> 'start')), ('gap', (SELECT count(*) FROM r WHERE gap)), ('unknown kind', (SELECT count(*) FROM r WHERE unknown)), ('after the end', (SELECT count(*) FROM r WHERE stop < last))) t(fault, n)""",
    "answer_keys": """SELECT n_nationkey, sha256('{"version":2,"question":"' || n_name || '","mode":"find"}') AS identity FROM nation""",
    "patch_gold": """SELECT p_partkey::VARCHAR AS task, 'src/f' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 4 < 2 AND p_partkey % 5 > 0""",
}
