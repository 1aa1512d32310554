"""Queries on small odd tables give the rows of their SQL."""

import duckdb
import pytest
from test_oracles import rows

from sextant import catalogue

#: Lines that begin or end with digits, blank ones of several kinds, and blanks at their ends.
TEXTS = ["0 first 0\n1 second 1\nthird 12 \n3", "\n1\n0", "plain \n \n  b1  \n\tc2\n4 e4", "007 000\n\n101\n202", "", "\n\n", "00\n11", "9" * 70 + "0"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "first 0"), (2, "none")], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", ["head_lines", "judge_states", "sentences", "term_rarity"])
def test_odd(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    assert rows(catalogue.QUERIES[name](spark, odd).toPandas()) == rows(con.execute(catalogue.SQL[name]).df())
