"""Registered queries over hierarchies and graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import Duck
from sextant.operators import graph as X
from sextant.operators import tree as H
from sextant.sources.shared import written
from sextant.sources.tables import table, unit_path

GENERIC = ["txt", "doc", "src"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(unit_path().alias("path"), F.col("n_chars").alias("size"))


def uses(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers refer to parts: names are the orders, lines the line numbers."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    how = F.element_at(F.array(*[F.lit(s) for s in X.STRENGTH]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        key("s", "l_suppkey").alias("from"), key("p", "l_partkey").alias("to"), F.array(F.col("l_orderkey").cast("string")).alias("names"), (F.col("l_returnflag") == "R").alias("type_only"), how.alias("how"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linestatus") == "F", key("v", "l_linenumber")).alias("via"),
    )


def subtree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return H.nodes(files(spark, sf))


def child_order(spark: SparkSession, sf: str) -> DataFrame:
    return H.children(H.nodes(files(spark, sf)))


def dir_themes(spark: SparkSession, sf: str) -> DataFrame:
    return H.themes(files(spark, sf), GENERIC)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(unit_path().alias("path"), (F.col("quality") * 0.75 + F.col("toxic") * 0.25).alias("value"))


def dir_heat(spark: SparkSession, sf: str) -> DataFrame:
    return H.heat(judged(spark, sf))


def nearest_mark(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "documents").where("n_chars > 20000").select(F.concat_ws("/", "lang", "source").alias("dir"))
    return H.nearest(files(spark, sf), marks)


def edge_merge(spark: SparkSession, sf: str) -> DataFrame:
    return X.merge(uses(spark, sf)).withColumn("names", F.array_join("names", ","))


def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return X.degrees(X.merge(uses(spark, sf)))


def fan_in_hubs(spark: SparkSession, sf: str) -> DataFrame:
    edges = written(X.merge(uses(spark, sf)).select("from", "to"))
    return X.degrees(edges).crossJoin(F.broadcast(X.hub_threshold(edges))).where("fan_in > threshold").select("node", "fan_in", "threshold")


def neighbour_list(spark: SparkSession, sf: str) -> DataFrame:
    return X.neighbours(X.merge(uses(spark, sf)), "s3")


def coverage_frontier(spark: SparkSession, sf: str) -> DataFrame:
    examined = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return X.frontier(X.merge(uses(spark, sf)), examined)


def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    edges = written(X.merge(uses(spark, sf)).select("from", "to"))
    nodes = edges.select(F.col("from").alias("node")).unionAll(edges.select("to"))
    examined = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    unresolved = table(spark, sf, "part").where("p_size > 45")
    return X.coverage(nodes, edges, examined, unresolved)


def external_use(spark: SparkSession, sf: str) -> DataFrame:
    ext = table(spark, sf, "part").select(F.col("p_name").alias("file"), F.col("p_brand").alias("pkg"), F.concat_ws("/", "p_brand", "p_type").alias("spec"), F.array("p_type").alias("names"), F.col("p_size").alias("line"))
    return X.external_users(ext, "Brand#1")


def reexports(spark: SparkSession, sf: str) -> DataFrame:
    """Nations pass on to nations of smaller key, in and out of regions; some run in circles."""
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return n.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("file"), F.lit("x").alias("name"), F.concat(F.lit("c"), F.floor(F.col("k") * 7 % 101 + F.col("n")).cast("string")).alias("to"), F.lit("x").alias("to_name"), (F.col("n") % 3).alias("priority"))


def barrel_chase(spark: SparkSession, sf: str) -> DataFrame:
    r = reexports(spark, sf)
    return X.chase(r.select("file", "name").distinct(), r).select("file", "defined_in", "hops")


QUERIES = {f.__name__: f for f in (subtree_rollup, child_order, dir_themes, dir_heat, nearest_mark, edge_merge, node_degrees, fan_in_hubs, neighbour_list, coverage_frontier, coverage_report, external_use, barrel_chase)}

_FILES = "f AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, n_chars AS size FROM documents)"
_ABOVE = "[array_to_string(string_split({0}, '/')[1:i], '/') FOR i IN range(1, len(string_split({0}, '/')))]"
_TREE = f"""WITH {_FILES}, e AS (SELECT unnest(list_concat([''], {_ABOVE.format('path')})) AS path, 'dir' AS kind, size FROM f UNION ALL SELECT path, 'file', size FROM f),
    t AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, kind,
        (CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END)::INT AS depth, sum(size)::BIGINT AS size, count(*) AS files FROM e GROUP BY path, kind)"""
_USES = """u AS (SELECT 's' || l_suppkey AS "from", 'p' || l_partkey AS "to", l_orderkey::VARCHAR AS name, l_returnflag = 'R' AS type_only, l_linenumber % 4 AS strength, l_linenumber AS line,
        CASE WHEN l_linestatus = 'F' THEN 'v' || l_linenumber END AS via FROM lineitem),
    m AS (SELECT "from", "to", string_agg(DISTINCT name, ',' ORDER BY name) AS names, bool_and(type_only) AS type_only, ['import', 'require', 'dynamic', 'reexport'][(max(strength) + 1)::INT] AS how,
        min(line) AS line, CASE WHEN count(*) FILTER (via IS NULL) = 0 THEN min(via) END AS via FROM u GROUP BY "from", "to")"""
_DEG = """d AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT "to" AS node, 1 AS i, 0 AS o FROM m UNION ALL SELECT "from", 0, 1 FROM m) GROUP BY node)"""
_SEEN = "x AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_suppkey % 2 = 0)"
_FRONT = """b AS (SELECT "from" AS a, "to" AS b FROM m UNION ALL SELECT "to", "from" FROM m),
    fr AS (SELECT b AS node, count(*) AS links FROM b WHERE a IN (SELECT node FROM x) AND b NOT IN (SELECT node FROM x) GROUP BY b)"""
_WORDS = f"list_filter({Duck.split_ident('regexp_replace(name, ' + chr(39) + '(\\.(test|spec|stories|d))?\\.[^.]+$' + chr(39) + ', ' + chr(39) + chr(39) + ')')}, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('txt', 'doc', 'src'))"

SQL = {
    "subtree_rollup": f"{_TREE} SELECT * FROM t",
    "child_order": f"{_TREE} SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY kind, name)::INT AS place FROM t WHERE path <> ''",
    "dir_themes": f"""WITH {_FILES}, dirs AS (SELECT DISTINCT unnest({_ABOVE.format('path')}) AS d FROM f),
        below AS (SELECT unnest({_ABOVE.format('path')}) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM f UNION ALL SELECT unnest({_ABOVE.format('d')}), regexp_extract(d, '([^/]*)$', 1) FROM dirs),
        here AS (SELECT dir, word, count(*) AS here FROM (SELECT dir, unnest({_WORDS}) AS word FROM below) GROUP BY ALL),
        names AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS name FROM f UNION ALL SELECT regexp_extract(d, '([^/]*)$', 1) FROM dirs),
        whole AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM names) GROUP BY word),
        s AS (SELECT dir, word, round(here * here / n, 6) AS score FROM here JOIN whole USING (word))
        SELECT dir, word, score, row_number() OVER (PARTITION BY dir ORDER BY score DESC, word)::INT AS rank FROM s QUALIFY rank <= 16""",
    "dir_heat": f"""WITH j AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, coalesce(quality * 0.75::DOUBLE + toxic * 0.25::DOUBLE, 0) AS v FROM documents LEFT JOIN labels USING (doc_id)),
        e AS (SELECT unnest(list_concat([path], {_ABOVE.format('path')})) AS path, v FROM j) SELECT path, max(v) AS heat FROM e GROUP BY path""",
    "nearest_mark": f"""WITH {_FILES}, k AS (SELECT DISTINCT lang || '/' || source AS dir FROM documents WHERE n_chars > 20000),
        e AS (SELECT path, unnest({_ABOVE.format('path')}) AS dir FROM f), n AS (SELECT path, max_by(dir, length(dir)) AS near FROM e JOIN k USING (dir) GROUP BY path)
        SELECT path, coalesce(near, string_split(path, '/')[1]) AS cluster FROM f LEFT JOIN n USING (path)""",
    "edge_merge": f"WITH {_USES} SELECT * FROM m",
    "node_degrees": f"WITH {_USES}, {_DEG} SELECT * FROM d",
    "fan_in_hubs": f"""WITH {_USES}, {_DEG}, o AS (SELECT fan_in, row_number() OVER (ORDER BY fan_in) AS rn, count(*) OVER () AS n FROM d),
        t AS (SELECT greatest(max(fan_in), 10)::BIGINT AS threshold FROM o WHERE rn = least(n, floor(n * 0.98) + 1)) SELECT node, fan_in, threshold FROM d CROSS JOIN t WHERE fan_in > threshold""",
    "neighbour_list": f"""WITH {_USES}, r AS (SELECT "to" AS neighbour, 0 AS side, line FROM m WHERE "from" = 's3' UNION ALL SELECT "from", 1, line FROM m WHERE "to" = 's3'),
        g AS (SELECT neighbour, min(side * 1000 + line) AS k FROM r GROUP BY neighbour) SELECT neighbour, row_number() OVER (ORDER BY k, neighbour)::INT AS place FROM g""",
    "coverage_frontier": f"WITH {_USES}, {_SEEN}, {_FRONT} SELECT * FROM fr",
    "coverage_report": f"""WITH {_USES}, {_SEEN}, {_FRONT}, n AS (SELECT "from" AS node FROM m UNION SELECT "to" FROM m)
        SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE node IN (SELECT node FROM x)) AS examined, (SELECT count(*) FROM fr) AS frontier,
        (SELECT count(*) FROM part WHERE p_size > 45) AS unresolved, (SELECT count(*) FROM n WHERE node NOT IN (SELECT node FROM x)) AS unexamined""",
    "external_use": """SELECT p_name AS file, min(p_size) AS line FROM part WHERE p_brand = 'Brand#1' OR starts_with(p_brand || '/' || p_type, 'Brand#1/') GROUP BY p_name""",
    "barrel_chase": """WITH RECURSIVE r AS (SELECT 'c' || c_custkey AS file, 'c' || (c_custkey * 7 % 101 + c_nationkey)::BIGINT AS dest FROM customer),
        c AS (SELECT file, file AS pos, 0 AS hops, [file] AS seen FROM (SELECT DISTINCT file FROM r) UNION ALL
            SELECT c.file, r.dest, c.hops + 1, list_append(seen, r.dest) FROM c JOIN r ON c.pos = r.file WHERE c.hops < 8 AND NOT list_contains(seen, r.dest))
        SELECT file, max_by(pos, hops) AS defined_in, max(hops)::INT AS hops FROM c GROUP BY file""",
}
