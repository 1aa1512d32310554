"""Registered queries of evaluation, dense retrieval, navigation, charts, ledgers and facts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions.text import Duck
from sextant.operators import dense as D
from sextant.operators import evaluate as E
from sextant.operators import flow as W
from sextant.operators import judge as J
from sextant.operators import navigate as N
from sextant.operators import tree as H
from sextant.plans import lexical
from sextant.plans.structure import files, judged
from sextant.sources.tables import table, unit_path, units
from sextant.streaming import ledger as R


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as chunks, and as queries the first vector of each label."""
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return e.select(F.col("vec_id").alias("file"), "embedding"), e.join(F.broadcast(first), ["label", "vec_id"]).select(F.col("label").alias("query"), "embedding")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return D.rank_files(*vectors(spark, sf))


def dense_chunk_max(spark: SparkSession, sf: str) -> DataFrame:
    chunks, queries = vectors(spark, sf)
    return D.rank_files(chunks.withColumn("file", F.floor(F.col("file") / 5)), queries)


def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    own = units(spark, sf).select("path", D.token_windows(T.plain_words(F.col("body"))).alias("w"))
    return own.select("path", F.size("w").alias("windows"), F.aggregate("w", F.lit(0), lambda a, x: a + F.size(x)).alias("tokens"))


def _run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs = dense_topk(spark, sf).select(F.col("query").alias("task"), F.col("file").alias("path"), "rank")
    qrels = table(spark, sf, "embeddings").select(F.col("label").alias("task"), F.col("vec_id").alias("path"))
    return qrels.select("task").distinct(), runs, qrels


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.metrics(*_run(spark, sf))


def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval_metrics(spark, sf).select((F.col("task") % 2).alias("half"), "hit1", "mrr10", (F.col("task") * 3 % 7).alias("ms"))
    return E.summary(rows, ["half"])


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return E.sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 50, "seed-1")


def jaccard_runs(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(E.jaccard(of("O"), of("F")), 6).alias("agreement"))


def find_candidates(spark: SparkSession, sf: str) -> DataFrame:
    own = judged(spark, sf).select("path", F.coalesce("value", F.lit(0.0)).alias("belief"))
    return N.find_candidates(own, lexical.QUERIES["bm25f_all"](spark, sf))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    own = judged(spark, sf).select(J.verdict(F.coalesce("value", F.lit(0.0))).alias("verdict"))
    return own.groupBy("verdict").agg(F.count("*").alias("n"))


def map_results(spark: SparkSession, sf: str) -> DataFrame:
    return N.map_results(judged(spark, sf).select("path", F.coalesce("value", F.lit(0.0)).alias("belief")))


def beam_walk(spark: SparkSession, sf: str) -> DataFrame:
    """A child's probability is its share of its siblings' sizes."""
    tree = H.nodes(files(spark, sf)).where("path <> ''")
    total = tree.groupBy("parent").agg(F.sum("size").alias("all"))
    return N.walk(tree.join(total, "parent").select("parent", "path", "kind", (F.col("size") / F.col("all")).alias("p"), F.lit(1.0).alias("under"))).drop("step")


def trace(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "value", "ts")


def loss_attribution(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(s) for s in N.STAGES]), (F.length("type") % 9 + 1).cast("int"))
    return N.attribute_loss(trace(spark, sf).select("run", F.col("seq").cast("string").alias("path"), stage.alias("stage"), F.col("value").alias("child_p")))


def backtracks(spark: SparkSession, sf: str) -> DataFrame:
    return N.backtracks(trace(spark, sf).select("run", F.col("seq").alias("step"), F.col("type").alias("path"))).groupBy("from_path", "to_path").agg(F.count("*").alias("n"))


def flow_seeds(spark: SparkSession, sf: str) -> DataFrame:
    own = judged(spark, sf).where("value is not null")
    return W.seeds(own.select("path", F.regexp_extract("path", "^([^/]*/[^/]*)/", 1).alias("cluster"), F.col("value").alias("score")))


def code_windows(spark: SparkSession, sf: str) -> DataFrame:
    return W.windows(lexical.line_evidence_scores(spark, sf))


def flow_titles(spark: SparkSession, sf: str) -> DataFrame:
    return W.titles(table(spark, sf, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"), "p_type").alias("path")))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in W.ROLES]), (F.col("s_nationkey") % 10 + 1).cast("int"))
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), (F.col("s_suppkey") % 13 / 12).alias("part"), (F.col("s_suppkey") % 3 == 0).alias("seed"), role.alias("role"), F.lit(0.5).alias("role_confidence"))


def flow_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return W.cut_nodes(_parts(spark, sf)).select("path", "place")


def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    k = F.col("s_suppkey")
    edges = table(spark, sf, "supplier").select(s(k).alias("from"), s(k * 5 % 101).alias("to"), (k % 11 / 10).alias("carries"))
    return W.cut_edges(edges, W.cut_nodes(_parts(spark, sf)))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 3).cast("string").alias("identity"), F.col("value").alias("amount"))


def minute_admission(spark: SparkSession, sf: str) -> DataFrame:
    return R.admissions(requests(spark, sf), 1, 2).select("id", "decision")


def daily_budget(spark: SparkSession, sf: str) -> DataFrame:
    return R.daily_budget(requests(spark, sf), 500.0).select("id", "within")


def ttl_cache(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return R.live_cache(own, "2024-01-15 00:00:00").select("key", "id")


def run_replay(spark: SparkSession, sf: str) -> DataFrame:
    return R.final_state(trace(spark, sf))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return R.sessions(table(spark, sf, "events").select(F.col("user_id").alias("identity"), "ts")).groupBy("identity").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def html_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Title and headings of pages (F20), without tags."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "[ \\t\\r\\n]+", " "))
    heads = F.transform(F.regexp_extract_all("html", F.lit("(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), bare)
    return table(spark, sf, "pages").select("page_id", bare(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.array_join(heads, "|").alias("headings"))


def json_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of JSON texts and how many texts have each (F8)."""
    return table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("path", T.line_count(F.col("body")).alias("lines"), T.ext_of(T.base_name(F.col("path"))).alias("ext"), T.estimate_tokens(F.length("body")).cast("long").alias("tokens"))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("path", T.first_sentence(F.col("sig")).alias("sentence"), T.clip(F.col("sig"), 60).alias("clipped"))


QUERIES = {
    f.__name__: f
    for f in (dense_topk, dense_chunk_max, token_windows, retrieval_metrics, metric_summary, seeded_sample, jaccard_runs, find_candidates, verdicts, map_results, beam_walk, loss_attribution, backtracks, flow_seeds, code_windows, flow_titles, flow_nodes, flow_edges, minute_admission, daily_budget, ttl_cache, run_replay, user_sessions, html_facts, json_keys, line_counts, sentences)
}

_VEC = """q AS (SELECT label AS query, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label),
    p AS (SELECT query, vec_id AS file, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS c FROM embeddings CROSS JOIN q)"""
_TOP = f"{_VEC}, b AS (SELECT query, file, round(max(c), 5) AS score FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file)::INT AS rank FROM b QUALIFY rank <= 10)"
_METRICS = f"""{_TOP}, h AS (SELECT r.query AS task, min(rank) AS first, count(*) FILTER (rank <= 5) AS in5, count(*) AS in10, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN embeddings e ON e.label = r.query AND e.vec_id = r.file GROUP BY 1),
    s AS (SELECT label AS task, count(*) AS size FROM embeddings GROUP BY label),
    m AS (SELECT task, coalesce((first <= 1)::INT, 0) AS hit1, coalesce((first <= 5)::INT, 0) AS hit5, coalesce((first <= 10)::INT, 0) AS hit10, round(coalesce(in5 / size, 0), 6) AS recall5, round(coalesce(in10 / size, 0), 6) AS recall10,
        round(coalesce(1 / first, 0), 6) AS mrr10, round(coalesce(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(size, 10) + 1)]), 0), 6) AS ndcg10 FROM s LEFT JOIN h USING (task))"""
_JUDGED = "j AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, quality * 0.75::DOUBLE + toxic * 0.25::DOUBLE AS value FROM documents LEFT JOIN labels USING (doc_id))"
_ROLE = "[" + ", ".join(f"'{r}'" for r in W.ROLES) + "]"
_STAGE = "[" + ", ".join(f"'{s}'" for s in N.STAGES) + "]"
_NODES = f"""n AS (SELECT 's' || s_suppkey AS path, s_suppkey % 13 / 12 AS part, s_suppkey % 3 = 0 AS seed, {_ROLE}[s_nationkey % 10 + 1] AS role FROM supplier),
    k AS (SELECT *, row_number() OVER (ORDER BY seed DESC, part DESC, path)::INT AS place FROM n WHERE part >= 0.5 QUALIFY place <= 36)"""


def _step(i: int, level: int) -> str:
    """Folders and files below what round ``i`` has, the best three of these and of finished files."""
    return f"""w{i + 1} AS (SELECT * FROM (SELECT * FROM w{i} WHERE kind = 'file' UNION ALL
        SELECT t.path, t.kind, w.product * t.p, w.decisions + 1, round(exp(ln(w.product * t.p) / (w.decisions + 1)), 6) FROM w{i} w JOIN t ON t.parent = w.path WHERE w.kind = 'dir') ORDER BY score DESC, path LIMIT 3)"""


SQL = {
    "dense_topk": f"WITH {_TOP} SELECT * FROM r",
    "dense_chunk_max": f"WITH {_TOP.replace('vec_id AS file', 'vec_id // 5 AS file')} SELECT * FROM r",
    "token_windows": f"""WITH {Duck.units()}, t AS (SELECT path, regexp_extract_all(lower(regexp_replace(body, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z][a-z0-9_]{{2,}}') AS t FROM units),
        s AS (SELECT path, len(t) AS n, CASE WHEN len(t) = 0 THEN []::BIGINT[] ELSE range(0, greatest(len(t) - 32 - 1, 0) + 1, 160) END AS s FROM t)
        SELECT path, len(s)::INT AS windows, coalesce(list_sum([least(192, n - i) FOR i IN s]), 0)::INT AS tokens FROM s""",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "metric_summary": f"""WITH {_METRICS}, x AS (SELECT task % 2 AS half, hit1, mrr10, task * 3 % 7 AS ms FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY ms) AS k, count(*) OVER (PARTITION BY half) AS n FROM x)
        SELECT half, count(*) AS tasks, round(avg(hit1), 6) AS hit1, round(avg(mrr10), 6) AS mrr10, max(ms) FILTER (k = least(n, floor(n * 0.5) + 1)) AS p50, max(ms) FILTER (k = least(n, floor(n * 0.95) + 1)) AS p95 FROM o GROUP BY half""",
    "seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY sha256('seed-1' || doc_id), doc_id LIMIT 50",
    "jaccard_runs": """WITH g AS (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []) AS b FROM orders GROUP BY 1)
        SELECT o_custkey, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS agreement FROM g""",
    "find_candidates": f"""WITH {_JUDGED}, b AS (SELECT path, 0 AS lane, -coalesce(value, 0) AS k FROM j ORDER BY k, path LIMIT 16), h AS ({lexical.SQL["bm25f_all"]}),
        m AS (SELECT path, 1 AS lane, rank::DOUBLE AS k FROM h WHERE path NOT IN (SELECT path FROM b) ORDER BY rank LIMIT 8), u AS (SELECT * FROM b UNION ALL SELECT * FROM m)
        SELECT path, lane, row_number() OVER (ORDER BY lane, k, path)::INT AS place FROM u""",
    "verdicts": f"WITH {_JUDGED} SELECT CASE WHEN coalesce(value, 0) >= 0.7 THEN 'found' WHEN coalesce(value, 0) >= 0.35 THEN 'partial' ELSE 'absent' END AS verdict, count(*) AS n FROM j GROUP BY 1",
    "map_results": f"WITH {_JUDGED} SELECT path, value AS belief FROM j WHERE value >= 0.35 ORDER BY belief DESC, path LIMIT 80",
    "beam_walk": f"""WITH x AS (SELECT lang, lang || '/' || source AS s, lang || '/' || source || '/doc_' || doc_id || '.txt' AS d, n_chars FROM documents),
        a AS (SELECT '' AS parent, lang AS path, 'dir' AS kind, sum(n_chars) AS size FROM x GROUP BY lang UNION ALL SELECT lang, s, 'dir', sum(n_chars) FROM x GROUP BY lang, s UNION ALL SELECT s, d, 'file', n_chars FROM x),
        t AS (SELECT parent, path, kind, size / sum(size) OVER (PARTITION BY parent) AS p FROM a), w0 AS (SELECT '' AS path, 'dir' AS kind, 1.0::DOUBLE AS product, 0 AS decisions, 1.0::DOUBLE AS score),
        {", ".join(_step(i, i) for i in range(4))} SELECT path, kind, score FROM w4""",
    "loss_attribution": f"""WITH s AS (SELECT user_id AS run, event_id::VARCHAR AS path, (length(event_type) % 9 + 1)::INT AS s, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY s DESC, value DESC, path DESC) AS k FROM s)
        SELECT run, path, {_STAGE}[s] AS stage FROM r WHERE k = 1""",
    "backtracks": """WITH l AS (SELECT event_type AS path, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
        SELECT last AS from_path, path AS to_path, count(*) AS n FROM l WHERE last IS NOT NULL AND path <> last AND NOT starts_with(path, last || '/') GROUP BY ALL""",
    "flow_seeds": f"""WITH {_JUDGED}, c AS (SELECT path, regexp_extract(path, '^([^/]*/[^/]*)/', 1) AS cluster, value AS score FROM j WHERE value >= 0.7),
        k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, path) <= 6) SELECT path, cluster, score FROM k ORDER BY score DESC, path LIMIT 20""",
    "code_windows": f"""WITH l AS ({lexical.SQL["line_evidence_scores"]}), g AS (SELECT *, (line - coalesce(lag(line) OVER (PARTITION BY path ORDER BY line), -1000000) > 5)::INT AS new FROM l),
        i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line) AS island FROM g)
        SELECT path, greatest(min(line) - 2, 1)::INT AS first, (max(line) + 2)::INT AS last, max(score) AS best FROM i GROUP BY path, island""",
    "flow_titles": """WITH x AS (SELECT p_brand || '/' || p_partkey || '/' || p_type AS path, p_type AS name, p_partkey FROM part)
        SELECT path, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN p_partkey || '/' || name ELSE name END AS title FROM x""",
    "flow_nodes": f"WITH {_NODES} SELECT path, place FROM k",
    "flow_edges": f"""WITH {_NODES}, e AS (SELECT 's' || s_suppkey AS a, 's' || (s_suppkey * 5 % 101) AS b, s_suppkey % 11 / 10 AS carries FROM supplier),
        o AS (SELECT e.*, x.role AS ra, y.role AS rb FROM e JOIN k x ON x.path = a JOIN k y ON y.path = b), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM o UNION ALL SELECT b FROM o) GROUP BY node),
        f AS (SELECT o.*, ra = 'handler' AND rb = 'guard' AS flipped FROM o JOIN d p ON p.node = a JOIN d q ON q.node = b WHERE carries >= 0.35 OR p.degree = 1 OR q.degree = 1)
        SELECT CASE WHEN flipped THEN b ELSE a END AS "from", CASE WHEN flipped THEN a ELSE b END AS "to", carries, flipped FROM f ORDER BY carries DESC, 1, 2 LIMIT 64""",
    "minute_admission": """WITH e AS (SELECT event_id AS id, ts, date_trunc('minute', ts) AS minute, user_id % 3 AS identity FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY minute, identity ORDER BY ts, id) <= 1 AS fits FROM e), t AS (SELECT *, sum(fits::INT) OVER (PARTITION BY minute ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS total FROM n)
        SELECT id, CASE WHEN NOT fits THEN 'identity' WHEN total > 2 THEN 'global' ELSE 'admitted' END AS decision FROM t""",
    "daily_budget": """SELECT event_id AS id, round(sum(value) OVER (PARTITION BY user_id % 3, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) <= 500 AS within FROM events""",
    "ttl_cache": """WITH a AS (SELECT user_id AS key, ts, event_id AS id FROM events WHERE ts > TIMESTAMP '2024-01-14 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'),
        l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) = 1) SELECT key, id FROM l ORDER BY ts DESC, id DESC LIMIT 100""",
    "run_replay": "SELECT user_id AS run, max_by(event_type, event_id) AS last, count(*) AS events FROM events GROUP BY 1",
    "user_sessions": """WITH l AS (SELECT user_id, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE) AS gap FROM events)
        SELECT user_id::BIGINT AS identity, 1 + count(*) FILTER (gap) AS sessions, count(*) AS events FROM l GROUP BY 1""",
    "html_facts": r"""WITH b AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1) AS h FROM pages)
        SELECT page_id, trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS title,
        coalesce(array_to_string(list_transform(h, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g'))), '|'), '') AS headings FROM b""",
    "json_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "line_counts": f"""WITH {Duck.units()} SELECT path, (len(string_split(body, chr(10))) - (CASE WHEN ends_with(body, chr(10)) THEN 1 ELSE 0 END))::INT AS lines, '.txt' AS ext, ceil(length(body) / {T.CHARS_PER_TOKEN}::DOUBLE)::BIGINT AS tokens FROM units""",
    "sentences": f"""WITH {Duck.units()}, s AS (SELECT path, sig, regexp_extract(sig, '(?s)^(.+?[.!?])(\\s|$)', 1) AS f, substr(sig, 1, 59) AS c, regexp_replace(substr(sig, 1, 59), '\\s+\\S*$', '') AS w FROM units)
        SELECT path, substr(CASE WHEN f = '' THEN sig ELSE f END, 1, 150) AS sentence, CASE WHEN length(sig) <= 60 THEN sig WHEN length(c) - length(w) <= 24 THEN w || '…' ELSE c || '…' END AS clipped FROM s""",
}
