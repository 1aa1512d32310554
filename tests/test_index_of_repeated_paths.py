"""An index of units that share paths gives the rows of SQL; units with paths of their own are counted without a shuffle of their terms."""

import duckdb
import pytest
from test_oracles import rows

from sextant import catalogue
from sextant.operators import lexical as L
from sextant.sources import snapshot

DOCS = [(1, "hand things\nthe hand edition", "en", "src3"), (1, "things ertion of others", "en", "src3"), (1, "hand", "de", "src3"), (2, "", "en", "src1"), (2, "others edition " * 9, "en", "src1"), (3, "thing " * 3 + "\n" + "x " * 300, "de", "src3")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("shared_paths"))
    spark.createDataFrame([(*r, len(r[1])) for r in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["vocab_df", "group_counts", "question_forms"])
def test_shared_paths(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    assert rows(catalogue.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(catalogue.SQL[name]).df())


def test_counts(spark):
    units = spark.createDataFrame([("a/x.ts", "x of y1", "y1 y1 b c"), ("a/x.ts", "y1", None), (None, "b", "b"), (None, None, "b c"), ("b", "", "")], "path string, sig string, body string")
    got = {(r.path, r.term): (r.tf_path, r.tf_sig, r.tf_body) for r in L.build(units).postings.collect()}
    assert got[("a/x.ts", "y1")] == (0, 2, 2) and got[("a/x.ts", "ts")] == (4, 0, 0) and got[("a/x.ts", "of")] == (0, 1, 0)
    many = spark.createDataFrame([("p", "", "ab\n" * 50_000), ("p", "", "ab\n" * 50_000), ("q", "", "ab\n" * 70_000)], "path string, sig string, body string")
    assert {(r.path, r.tf_body) for r in L.build(many).postings.where("term = 'ab'").collect()} == {("p", 65_535), ("q", 65_535)}


def test_no_shuffle_of_terms(spark):
    units = spark.range(50).selectExpr("concat('d/f', id) AS path", "'some words' AS sig", "concat('text of ', id, ' more words') AS body")
    df = L.vocabulary(L.build(units))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(term" in final and "hashpartitioning(path" not in final


def test_integrity_of_faulty_postings(spark):
    postings = spark.createDataFrame([("a", "t", 1, 0, 0), ("a", "t", 1, 0, 0), ("b", "t", 1, 0, 0), ("b", "u", 0, 0, 1)], "path string, term string, tf_path long, tf_sig long, tf_body long")
    stats = spark.createDataFrame([("a", 1, 0, 0)], "path string, len_path int, len_sig int, len_body int")
    edges = spark.createDataFrame([("a", "a")], "from string, to string")
    df = snapshot.integrity(L.Index(postings, stats), edges)
    got = {r.check: r.n for r in df.collect()}
    assert (got["postings without a document"], got["repeated postings"], got["counts above lengths"], got["loops"]) == (2, 1, 1, 1)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
