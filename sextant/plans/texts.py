"""Registered queries of text functions, paths, sources and snapshots, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions.query import variants
from sextant.functions.text import Duck
from sextant.operators import dense as D
from sextant.operators import lexical as L
from sextant.operators import navigate as N
from sextant.operators.resolve import normalised
from sextant.sources import snapshot as S
from sextant.sources.tables import table, units

GENERIC = ["widget", "bolt", "index", "test"]
#: Endings that the fixed file names take in turn.
ENDINGS = [".test.ts", ".json", ".PY", "", ".d.ts", ".exe", ".csv", ".env"]


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """part as files: path, name."""
    key = F.col("p_partkey")
    name = F.concat(F.when(key % 9 == 0, "Dockerfile").when(key % 31 == 0, ".hidden").otherwise(F.concat(F.initcap(F.split("p_name", " ")[0]), F.split("p_name", " ")[1], key.cast("string"))), F.get(F.array(*map(F.lit, ENDINGS)), (key % 8).cast("int")))
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", name.alias("name"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), name).alias("path"))


def name_words(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", F.array_join(T.name_words(F.col("name"), GENERIC), " ").alias("words"))


def ident_words(spark: SparkSession, sf: str) -> DataFrame:
    ident = F.concat(F.lit("get"), F.initcap(F.col("p_type")), F.lit("X_2_"), F.col("p_size").cast("string"), F.lit("URLs"))
    return _parts(spark, sf).select("p_partkey", F.array_join(T.ident_words(ident), " ").alias("words"))


def _opening() -> Column:
    return F.substring("body", 1, 300)


def prose_lines(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("path", T.flatten_prose(_opening()).alias("flat"), T.clip(T.flatten_prose(_opening()), 80).alias("clipped"))


def distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    kept = T.uniq(F.split(F.col("body"), " "))
    return units(spark, sf).select("path", F.size(kept).alias("kept"), F.get(kept, 1).alias("second"))


_ASKED = ["How does ", "please explain the ", "Where are the ", "can you find a ", "", "walk me through "]


def _question() -> Column:
    part = F.get(F.split("text", r"\."), 0)
    return F.concat(F.get(F.array(*map(F.lit, _ASKED)), (F.col("conv_id") % 6).cast("int")), part, F.when(F.col("turn") % 2 == 0, F.lit(" work?")).otherwise(F.lit("  ?")))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.topic(_question()).alias("topic"), N.strategy_of(_question()).alias("strategy"))


def normalized_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalized_question(F.concat(F.lit("  "), F.col("text"), F.lit("\n\t"))).alias("question"))


def name_uses(spark: SparkSession, sf: str) -> DataFrame:
    lines = units(spark, sf).select("path", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    return lines.where(T.uses_name(F.col("text"), "the")).groupBy("path").agg(F.count("*").alias("lines"))


def option_budgets(spark: SparkSession, sf: str) -> DataFrame:
    n = units(spark, sf).select(T.dir_of(F.col("path")).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))
    return n.select("dir", T.option_budget(F.col("n")).cast("long").alias("each"), T.option_budget(F.col("n") * 20).cast("long").alias("crowded"))


def _odd_path() -> Column:
    k = F.col("page_id") % 7
    rest = F.regexp_replace("url", r"^https?://|\?.*$", "")
    return F.when(k == 0, F.concat(F.lit("/"), rest)).when(k == 1, F.concat(F.lit("../"), rest)).when(k == 2, F.concat(rest, F.lit("/./x"))).when(k == 3, F.concat(F.lit("a\\"), rest)).when(k == 4, "").otherwise(rest)


def safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.safe_path(_odd_path()).alias("safe"))


def normalised_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with . and .. segments; what leaves the root is null."""
    up = F.repeat(F.lit("../"), (F.col("p_size") % 4).cast("int"))
    raw = F.concat(F.lit("a/./"), F.col("p_type"), F.lit("//"), up, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", normalised(raw).alias("path"), T.dir_of(normalised(raw)).alias("dir"))


def markdown_plain(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("![i](u.png) **"), F.col("p_name"), F.lit("** [see]("), F.col("p_brand"), F.lit(") `"), F.col("p_type"), F.lit("` <br> ~x_y~ "))
    return table(spark, sf, "part").select("p_partkey", T.markdown_text(text).alias("plain"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", D.content_hash(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("hash"))


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    u = D.unit(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get(u, 0), 6).alias("first"), F.round(D.norm(u), 6).alias("length"))


def encoder_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return D.chunk_texts(units(spark, sf)).select("path", "chunk", F.md5("text").alias("text"))


def readable_files(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", "name", T.ext_of(F.col("name")).alias("ext"), S.readable(F.col("path")).alias("readable"))


def index_fields(spark: SparkSession, sf: str) -> DataFrame:
    own = _parts(spark, sf).select("path", F.col("p_name").alias("sig"), F.col("p_type").alias("body"), F.array_repeat(F.lit("k"), (F.col("p_size") * 3).cast("int")).alias("keys"))
    return S.lexical_fields(own).groupBy("path", "sig", "body").agg(F.count("*").alias("n"))


def file_windows(spark: SparkSession, sf: str) -> DataFrame:
    got = S.file_window(units(spark, sf).withColumnRenamed("body", "text"), 2, 3)
    return got.select("path", F.array_join("lines", "|").alias("lines"), "total")


def head_lines(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("path", F.array_join(T.head_lines(F.col("body"), 3, 60), "|").alias("head"))


def snapshot_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Of an index with planted faults: a repeated path, an unsafe one, and edges to nowhere and to themselves."""
    index = L.build(units(spark, sf))
    stats = index.doc_stats.unionByName(index.doc_stats.where("path like 'en/src3/%'")).unionByName(index.doc_stats.where("path like 'de/%'").withColumn("path", F.concat(F.lit("../"), "path")))
    edges = units(spark, sf).select(F.col("path").alias("from"), F.when(F.length("body") % 5 == 0, F.col("path")).when(F.length("body") % 7 == 0, "nowhere").otherwise(F.concat(F.col("path"), F.lit("?"))).alias("to"))
    return S.integrity(L.Index(index.postings, stats), edges)


#: The words of a question and the forms under which they may stand.
ASKED = ["handing", "things", "edition", "others", "ghostly"]


def question_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Which forms of a question's words the vocabulary knows (L5, T5-T7): the forms are few, the vocabulary is not collected."""
    forms = spark.createDataFrame([(w, v) for w in ASKED for v in variants(w)], "word string, term string")
    return L.vocabulary(L.build(units(spark, sf))).join(F.broadcast(forms), "term").select("word", "term", "df")


QUERIES = {
    f.__name__: f
    for f in (
        name_words, ident_words, prose_lines, distinct_words, topics, normalized_questions, name_uses, option_budgets, safe_paths, normalised_paths, markdown_plain, content_hashes, unit_vectors, encoder_chunks, readable_files, index_fields,
        file_windows, head_lines, snapshot_integrity, question_forms,
    )
}

_ENDS = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + "]"
_FILES = f"""f AS (SELECT *, (CASE WHEN p_partkey % 9 = 0 THEN 'Dockerfile' WHEN p_partkey % 31 = 0 THEN '.hidden'
        ELSE upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || split_part(p_name, ' ', 2) || p_partkey END) || {_ENDS}[p_partkey % 8 + 1] AS name FROM part),
    p AS (SELECT *, replace(p_brand, '#', '-') || '/' || name AS path FROM f)"""
_FLAT = "(CASE WHEN regexp_matches(trim(regexp_replace(substr(body, 1, 300), '\\s+', ' ', 'g')), '\\p{L}{2}') THEN trim(regexp_replace(substr(body, 1, 300), '\\s+', ' ', 'g')) ELSE '' END)"
_ASKS = "[" + ", ".join(f"'{a}'" for a in _ASKED) + "]"
_QUESTION = f"q AS (SELECT conv_id, turn, {_ASKS}[conv_id % 6 + 1] || split_part(text, '.', 1) || (CASE WHEN turn % 2 = 0 THEN ' work?' ELSE '  ?' END) AS q FROM conversations)"
_READ = "[" + ", ".join(f"'{e}'" for e in sorted(S.READ)) + "]"
_EXT = "(CASE WHEN starts_with(lower(name), 'dockerfile') THEN 'dockerfile' ELSE regexp_extract(lower(name), '^.+(\\.[^.]+)$', 1) END)"
_KNOWN = ", ".join(f"('{w}', '{v}')" for w in ASKED for v in variants(w))

SQL = {
    "name_words": f"""WITH {_FILES}, b AS (SELECT p_partkey, regexp_replace(name, '(\\.(test|spec|stories|d))?\\.[^.]+$', '') AS bare FROM p)
        SELECT p_partkey, array_to_string(list_filter({Duck.split_ident('bare')}, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({", ".join(f"'{g}'" for g in GENERIC)})), ' ') AS words FROM b""",
    "ident_words": f"""WITH b AS (SELECT p_partkey, 'get' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || 'X_2_' || p_size || 'URLs' AS n FROM part)
        SELECT p_partkey, array_to_string(list_filter({Duck.split_ident('n')}, lambda x: length(x) > 1 AND NOT regexp_matches(x, '^[0-9]+$')), ' ') AS words FROM b""",
    "prose_lines": f"""WITH {Duck.units()}, t AS (SELECT path, {_FLAT} AS flat FROM units), c AS (SELECT *, substr(flat, 1, 79) AS c, regexp_replace(substr(flat, 1, 79), '\\s+\\S*$', '') AS w FROM t)
        SELECT path, flat, CASE WHEN length(flat) <= 80 THEN flat WHEN length(c) - length(w) <= 24 THEN w || '…' ELSE c || '…' END AS clipped FROM c""",
    "distinct_words": f"""WITH {Duck.units()}, e AS (SELECT path, unnest(string_split(body, ' ')) AS w, generate_subscripts(string_split(body, ' '), 1) AS k FROM units),
        g AS (SELECT path, w, min(k) AS k FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k) AS n FROM g)
        SELECT path, least(count(*), {T.LIST_CAP})::INT AS kept, max(w) FILTER (n = 2) AS second FROM r GROUP BY path""",
    "topics": f"""WITH {_QUESTION}, b AS (SELECT *, regexp_replace(regexp_replace(q, '{T.ASKING}', ''), '{T.ASKED}', '') AS t FROM q)
        SELECT conv_id, turn, CASE WHEN t = '' THEN q ELSE t END AS topic, CASE WHEN regexp_matches(q, '(?i)^\\s*(how|explain|trace)\\b|\\bflow\\b|walk me through') THEN 'explain' ELSE 'find' END AS strategy FROM b""",
    "normalized_questions": "SELECT conv_id, turn, trim(regexp_replace('  ' || text || chr(10) || chr(9), '\\s+', ' ', 'g')) AS question FROM conversations",
    "name_uses": f"""WITH {Duck.units()}, l AS (SELECT path, unnest(string_split(body, chr(10))) AS t FROM units)
        SELECT path, count(*) AS lines FROM l WHERE regexp_matches(t, '(^|[^A-Za-z0-9_$])the($|[^A-Za-z0-9_$])') GROUP BY path""",
    "option_budgets": f"""WITH {Duck.units()}, n AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM units GROUP BY 1)
        SELECT dir, greatest(45, least(160, 12000 // n))::BIGINT AS each, greatest(45, least(160, 12000 // (n * 20)))::BIGINT AS crowded FROM n""",
    "safe_paths": """WITH r AS (SELECT page_id, page_id % 7 AS k, regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', '') AS p FROM pages)
        SELECT page_id, k > 4 AND NOT regexp_matches(p, '(^|/)[.]{1,2}(/|$)') AS safe FROM r""",
    "normalised_paths": """WITH r AS (SELECT p_partkey, p_size % 4 AS k, p_type, p_name FROM part),
        n AS (SELECT p_partkey, CASE k WHEN 0 THEN 'a/' || p_type || '/' || p_name WHEN 1 THEN 'a/' || p_name WHEN 2 THEN p_name END AS path FROM r)
        SELECT p_partkey, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM n""",
    "markdown_plain": "SELECT p_partkey, p_name || ' see ' || p_type || '  xy' AS plain FROM part",
    "content_hashes": "SELECT p_partkey, sha256(length(p_name) || ':' || p_name || length(p_brand) || ':' || p_brand || length(p_type) || ':' || p_type) AS hash FROM part",
    "unit_vectors": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
        SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS first, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM e""",
    "encoder_chunks": f"""WITH {Duck.units()}, w AS (SELECT path, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS w FROM units),
        s AS (SELECT path, w, CASE WHEN len(w) = 0 THEN [0::BIGINT] ELSE range(0, greatest(len(w) - {D.OVERLAP} - 1, 0) + 1, {D.WINDOW - D.OVERLAP}) END AS s FROM w),
        e AS (SELECT path, w, unnest(s) AS a, unnest(range(0, len(s)))::INT AS chunk FROM s)
        SELECT path, chunk, md5(rtrim(path || ' ' || array_to_string(w[a + 1 : a + {D.WINDOW}], ' '))) AS text FROM e""",
    "readable_files": f"""WITH {_FILES} SELECT p_partkey, name, {_EXT} AS ext, {_EXT} IN {_READ} OR regexp_extract(lower(name), '^([^.]*)', 1) IN {S.READ_NAMES} AS readable FROM p""",
    "index_fields": f"""WITH {_FILES}, d AS (SELECT *, {_EXT} IN {S.DATA} AS data FROM p)
        SELECT path, CASE WHEN data AND p_size * 3 > {S.MOST_KEYS} THEN '' ELSE p_name END AS sig, CASE WHEN data THEN '' ELSE p_type END AS body, count(*) AS n FROM d GROUP BY ALL""",
    "file_windows": f"WITH {Duck.units()}, l AS (SELECT path, string_split(body, chr(10)) AS l FROM units) SELECT path, array_to_string(l[2:3], '|') AS lines, len(l)::INT AS total FROM l",
    "head_lines": f"""WITH {Duck.units()}, l AS (SELECT path, list_filter(list_transform(string_split(body, chr(10)), lambda x: rtrim(x)), lambda x: trim(x) <> '')[1:3] AS l FROM units)
        SELECT path, array_to_string(list_transform(l, lambda x: CASE WHEN length(x) > 60 THEN substr(x, 1, 59) || '…' ELSE x END), '|') AS head FROM l""",
    "snapshot_integrity": f"""WITH {Duck.units()} SELECT * FROM (VALUES ('repeated paths', (SELECT count(*) FROM units WHERE path LIKE 'en/src3/%')), ('unsafe paths', (SELECT count(*) FROM units WHERE path LIKE 'de/%')),
        ('postings without a document', 0), ('repeated postings', 0), ('counts above lengths', 0),
        ('edges without an end', (SELECT count(DISTINCT CASE WHEN length(body) % 7 = 0 THEN 'nowhere' ELSE path || '?' END) FROM units WHERE length(body) % 5 <> 0)),
        ('loops', (SELECT count(*) FROM units WHERE length(body) % 5 = 0))) t("check", n)""",
    "question_forms": f"""WITH {Duck.tokens()}, v AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT path, unnest(list_concat(tp, ts, tb)) AS term FROM toks) GROUP BY term), q(word, term) AS (VALUES {_KNOWN})
        SELECT word, term, df FROM q JOIN v USING (term)""",
}
