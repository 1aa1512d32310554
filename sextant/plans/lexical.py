"""Registered lexical queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions.text import Duck
from sextant.operators import lexical as L
from sextant.operators.lexical import Term
from sextant.sources.shared import written
from sextant.sources.tables import table, units

#: The fixed query.
TERMS = [Term("hand", ("hand",)), Term("thing", ("thing", "things")), Term("ention", ("ention", "ertion"), 0.5), Term("doc", ("doc",), 0.25), Term("src3", ("src3",))]
WORDS = ["hand", "thing", "ention"]


def _search(view: str, scope: str = ""):
    return lambda spark, sf: L.search_units(units(spark, sf), TERMS, view, scope)


def _search_sql(view: str, scope: str = "") -> str:
    w, b = L.WEIGHT, L.B
    short = {"path": "tp", "sig": "ts", "body": "tb"}
    terms = ", ".join(f"({i}, '{t.label}', '{v}', {float(t.weight)})" for i, t in enumerate(TERMS) for v in t.variants)
    wtf = " + ".join(f"{w[f]} * least(tf_{f}, {T.MAX_TF}) / ({1 - b[f]} + {b[f]} * len_{f} / avg_{f})" for f in L.VIEWS[view])
    where = f"path = '{scope}' OR starts_with(path, '{scope}/')" if scope else "true"
    return f"""WITH {Duck.tokens()},
        s AS (SELECT path, len(tp) AS len_path, len(ts) AS len_sig, len(tb) AS len_body FROM toks),
        c AS (SELECT count(*) AS n, coalesce(nullif(avg(len_path), 0), 1) AS avg_path, coalesce(nullif(avg(len_sig), 0), 1) AS avg_sig, coalesce(nullif(avg(len_body), 0), 1) AS avg_body FROM s),
        q AS (SELECT * FROM (VALUES {terms}) v(ti, label, term, weight)),
        e AS ({" UNION ALL ".join(f"SELECT path, '{f}' AS field, unnest({short[f]}) AS term FROM toks" for f in L.FIELDS)}),
        p AS (SELECT path, term, {", ".join(f"count(*) FILTER (field = '{f}') AS tf_{f}" for f in L.FIELDS)} FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        a AS (SELECT path, ti, label, weight, n, sum({wtf}) AS acc FROM p JOIN q USING (term) JOIN s USING (path) CROSS JOIN c GROUP BY ALL HAVING acc > 0),
        d AS (SELECT ti, count(*) AS df FROM a GROUP BY ti),
        r AS (SELECT path, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * acc / ({L.K1} + acc)), 6) AS score, string_agg(label, ',' ORDER BY ti) AS matched FROM a JOIN d USING (ti) GROUP BY path),
        f AS (SELECT * FROM r WHERE score > 0 AND ({where}))
        SELECT path, score, matched, row_number() OVER (ORDER BY score DESC, path)::INT AS rank FROM f QUALIFY rank <= 20"""


def vocab_df(spark: SparkSession, sf: str) -> DataFrame:
    return L.vocabulary(L.build(units(spark, sf)))


def term_rarity(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(u.select(F.substring("sig", 1, 40).alias("name")))
    return L.rarity(names, vocab_df(spark, sf), u.count()).withColumn("rarity", F.round("rarity", 6))


def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.group_df(L.build(units(spark, sf)), TERMS)


def split_ident(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(table(spark, sf, "customer").select(F.concat_ws("", "c_name", "c_mktsegment").alias("name")))
    return rows.select("name", F.array_join(T.split_ident(F.col("name")), " ").alias("parts"), F.array_join(T.tokenize(F.col("name")), " ").alias("tokens"))


def stem_tokens(spark: SparkSession, sf: str) -> DataFrame:
    each = units(spark, sf).select(F.explode(T.split_ident(T.body_text(F.col("body")))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).select("word", T.stem(F.col("word")).alias("stem"), "n")


def field_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return L.field_tokens(units(spark, sf)).select("path", *[F.size(f"t_{f}").alias(f"len_{f}") for f in L.FIELDS])


def pool_union(spark: SparkSession, sf: str) -> DataFrame:
    return L.pool_units(units(spark, sf), TERMS).select("path", "score", "rank")


def pool_index(spark: SparkSession, sf: str) -> DataFrame:
    index = L.build(units(spark, sf))
    return L.pool(L.Index(written(index.postings), written(index.doc_stats)), TERMS).select("path", "score", "rank")


def dir_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return L.anchors(L.search_units(units(spark, sf), TERMS, limit=10))


def grep_count(spark: SparkSession, sf: str) -> DataFrame:
    return L.grep(units(spark, sf), WORDS)


def bm25_plain(spark: SparkSession, sf: str) -> DataFrame:
    return L.plain_bm25(units(spark, sf), WORDS)


def prefix_relatives(spark: SparkSession, sf: str) -> DataFrame:
    return L.relatives(vocab_df(spark, sf), ["thing", "edition", "ention"])


def line_evidence_scores(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    return L.line_scores(u, TERMS[:3], L.unit_df(u, TERMS[:3]))


def evidence_windows(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    return L.evidence(u, TERMS[:3], L.unit_df(u, TERMS[:3])).select("path", F.array_join("shown", "\n").alias("shown"))


QUERIES = {
    "bm25f_all": _search("all"),
    "bm25f_path": _search("path"),
    "bm25f_path_sig": _search("path+sig"),
    "bm25f_scoped": _search("all", "en/src3"),
    "bm25f_index": lambda spark, sf: L.search(L.build(units(spark, sf)), TERMS),
    **{f.__name__: f for f in (vocab_df, term_rarity, group_counts, split_ident, stem_tokens, field_lengths, pool_union, pool_index, dir_anchors, grep_count, bm25_plain, prefix_relatives, line_evidence_scores, evidence_windows)},
}

_VOCAB = f"{Duck.tokens()}, v AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT path, unnest(list_concat(tp, ts, tb)) AS term FROM toks) GROUP BY term)"
_LIKE = " OR ".join(f"contains(lower(x), '{w}')" for w in WORDS)
_ANCHOR_BASE = _search_sql("all").replace("QUALIFY rank <= 20", "QUALIFY rank <= 10")
#: The first three terms: d0 to d2, documents that have each; in lines h0 to h2, whether each is there; and what they are worth together.
_COUNTED = "d AS (SELECT " + ", ".join(f"count(*) FILTER (list_has_any(list_concat(tp, ts, tb), {list(t.variants)})) AS d{i}" for i, t in enumerate(TERMS[:3])) + " FROM toks)"
_HITS = ", ".join(f"list_has_any(t, {list(t.variants)}) AND d{i} > 0 AS h{i}" for i, t in enumerate(TERMS[:3]))
_SCORE = "round(" + " + ".join(f"(CASE WHEN h{i} THEN {t.weight} / ln(2 + d{i}) ELSE 0 END)" for i, t in enumerate(TERMS[:3])) + ", 6)"


def _window(k: int) -> str:
    """The next window of evidence: around the best line that isn't shown yet."""
    return f"""p{k} AS (SELECT path, i AS c FROM k{k - 1} WHERE hits > 0 AND NOT keep QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, hits DESC, i) = 1),
        k{k} AS (SELECT path, i, x, is_full, score, hits, keep OR coalesce(i BETWEEN c - 2 AND c + 2, false) AS keep FROM k{k - 1} LEFT JOIN p{k} USING (path))"""



SQL = {
    "bm25f_all": _search_sql("all"),
    "bm25f_path": _search_sql("path"),
    "bm25f_path_sig": _search_sql("path+sig"),
    "bm25f_scoped": _search_sql("all", "en/src3"),
    "bm25f_index": _search_sql("all"),
    "vocab_df": f"WITH {_VOCAB} SELECT * FROM v",
    "term_rarity": f"""WITH {_VOCAB}, names AS (SELECT p_name AS name FROM part UNION SELECT substr(sig, 1, 40) FROM units),
        e AS (SELECT name, unnest(list_distinct({Duck.tokenize('name')})) AS term FROM names),
        r AS (SELECT name, max(ln(1 + ((SELECT count(*) FROM units) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) AS rarity FROM e LEFT JOIN v USING (term) GROUP BY name)
        SELECT name, round(coalesce(rarity, 0), 6) AS rarity FROM names LEFT JOIN r USING (name)""",
    "group_counts": f"""WITH {Duck.tokens()}, q AS (SELECT * FROM (VALUES {", ".join(f"('{t.label}', '{v}')" for t in TERMS for v in t.variants)}) v(label, term)),
        e AS (SELECT path, unnest(list_concat(tp, ts, tb)) AS term FROM toks) SELECT label, count(DISTINCT path) AS df FROM e JOIN q USING (term) GROUP BY label""",
    "split_ident": f"""WITH r AS (SELECT p_name AS name FROM part UNION ALL SELECT c_name || c_mktsegment FROM customer)
        SELECT name, array_to_string({Duck.split_ident('name')}, ' ') AS parts, array_to_string({Duck.tokenize('name')}, ' ') AS tokens FROM r""",
    "stem_tokens": f"""WITH {Duck.units()}, e AS (SELECT unnest({Duck.split_ident(Duck.body_text('body'))}) AS word FROM units),
        g AS (SELECT word, count(*) AS n FROM e GROUP BY word) SELECT word, {Duck.stem('word')} AS stem, n FROM g""",
    "field_lengths": f"WITH {Duck.tokens()} SELECT path, len(tp)::INT AS len_path, len(ts)::INT AS len_sig, len(tb)::INT AS len_body FROM toks",
    "dir_anchors": f"""WITH h AS ({_ANCHOR_BASE}), e AS (SELECT unnest([array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')))]) AS dir FROM h),
        c AS (SELECT dir, count(*) AS hits FROM e GROUP BY dir HAVING count(*) >= 2)
        SELECT dir, hits FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE starts_with(o.dir, c.dir || '/')) ORDER BY len(string_split(dir, '/')) DESC, hits DESC, dir LIMIT 3""",
    "grep_count": f"""WITH {Duck.units()}, c AS (SELECT path, len(list_filter(string_split(body, chr(10)), lambda x: {_LIKE}))::INT AS lines FROM units)
        SELECT * FROM c WHERE lines > 0 ORDER BY lines DESC, path LIMIT 20""",
    "bm25_plain": f"""WITH {Duck.units()}, t AS (SELECT path, regexp_extract_all(lower(regexp_replace(body, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z][a-z0-9_]{{2,}}') AS t FROM units),
        s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), q AS (SELECT unnest({WORDS}) AS w),
        c AS (SELECT path, len(t) AS l, w, len(list_filter(t, lambda x: x = w)) AS tf FROM t CROSS JOIN q), d AS (SELECT w, count(*) AS df FROM c WHERE tf > 0 GROUP BY w)
        SELECT path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
        FROM c JOIN d USING (w) CROSS JOIN s WHERE tf > 0 GROUP BY path ORDER BY score DESC, path LIMIT 20""",
    "prefix_relatives": f"""WITH {_VOCAB} SELECT DISTINCT term, df FROM v JOIN (SELECT unnest(['thing', 'edition', 'ention']) AS w) ON starts_with(term, w) OR starts_with(w, term)
        WHERE length(term) >= 4 AND term NOT IN ('thing', 'edition', 'ention')""",
    "line_evidence_scores": f"""WITH {Duck.tokens()}, {_COUNTED}, l AS (SELECT path, string_split(substr(body, 1, {T.MAX_BODY}), chr(10)) AS ls FROM units),
        e AS (SELECT path, unnest(ls) AS x, unnest(range(1, len(ls) + 1))::INT AS line FROM l), t AS (SELECT path, line, {Duck.tokenize('x')} AS t FROM e WHERE length(x) <= {T.MAX_LINE}),
        s AS (SELECT path, line, d.*, {_HITS} FROM t CROSS JOIN d)
        SELECT path, line, {_SCORE} AS score, ({" + ".join(f"h{i}::INT" for i in range(3))})::INT AS terms FROM s WHERE h0 OR h1 OR h2""",
    "evidence_windows": f"""WITH {Duck.tokens()}, {_COUNTED}, l AS (SELECT path, string_split(substr(body, 1, {T.MAX_BODY}), chr(10)) AS ls FROM units),
        e AS (SELECT path, unnest(ls) AS x, unnest(range(0, len(ls)))::INT AS i FROM l), t AS (SELECT path, i, x, CASE WHEN length(x) <= {T.MAX_LINE} THEN {Duck.tokenize('x')} ELSE [] END AS t FROM e),
        h AS (SELECT path, i, x, d.*, {_HITS} FROM t CROSS JOIN d), s AS (SELECT path, i, x, regexp_matches(x, '\\S') AS is_full, {_SCORE} AS score, h0::INT + h1::INT + h2::INT AS hits FROM h),
        k0 AS (SELECT *, is_full AND count(*) FILTER (is_full) OVER (PARTITION BY path ORDER BY i) <= 8 AS keep FROM s), {", ".join(_window(k) for k in (1, 2, 3))},
        o AS (SELECT *, count(*) FILTER (NOT keep) OVER (PARTITION BY path ORDER BY i) AS missed, regexp_replace(x, '\\s+$', '') AS y FROM k3 WHERE is_full),
        g AS (SELECT *, missed > lag(missed) OVER (PARTITION BY path ORDER BY i) AS gap FROM o WHERE keep),
        r AS (SELECT path, string_agg((CASE WHEN gap THEN '…' || chr(10) ELSE '' END) || (i + 1) || ': ' || (CASE WHEN length(y) <= 140 THEN y ELSE substr(y, 1, 139) || '…' END), chr(10) ORDER BY i) AS shown FROM g GROUP BY path)
        SELECT path, coalesce(shown, '') AS shown FROM units LEFT JOIN r USING (path)""",
}
SQL["pool_union"] = SQL["pool_index"] = f"""WITH a AS ({_search_sql("all").replace("QUALIFY rank <= 20", "")}), p AS ({_search_sql("path").replace("QUALIFY rank <= 20", "QUALIFY rank <= 10")}),
        u AS (SELECT path, 0 AS lane, rank FROM a WHERE rank <= 32 UNION ALL SELECT path, 1, rank FROM p WHERE path NOT IN (SELECT path FROM a WHERE rank <= 32))
        SELECT u.path, coalesce(a.score, p.score) AS score, row_number() OVER (ORDER BY lane, u.rank)::INT AS rank FROM u LEFT JOIN a USING (path) LEFT JOIN p USING (path)"""
