"""Every query with a DuckDB equivalent, compared on the smallest dataset (where it is present)."""

import os

import duckdb
import pytest

from siftlake.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in ("documents", "events", "pages", "labels"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", ["s1_fuzzy_terms", "s3_regex", "s7_document_lines_top20", "s9_doc_regex", "s12_duplicates", "t1_bm25_top", "j6_context_batch", "b3_expand_tree", "w6_latest_wins", "st2_collapse", "a12_error_rollup", "c1_chunks", "s14_fuzzy", "m2_upsert_lines", "st1_windows", "j13_rename_pairs", "x28_truncate_error", "w1_best_line_per_file", "b5_file_view"])
def test_query(name, spark, oracle):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = oracle.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_titles_of_odd_pages(spark, tmp_path):
    """References that are cut, stand for references or are not among the four; other tags, several titles, white space of all kinds."""
    titles = ["R&amp;D &amp", "&amp;lt; &lt;b&gt; &quot;", "&nbsp;&#39;&copy", " a \t\n\f\r b\x0b\u00a0c ", "", "&"]
    pages = [f"<html><title>{t}</title><title>second</title>" for t in titles]
    pages += [None, "", "<TITLE>upper</TITLE>", "<title lang=en>x</title>", "<title>open", "<title>a<b></title><title>whole</title>", "<!--<title>comment</title>-->"]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/*.parquet'")
    got = catalogue.queries()["e4_html_title"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalogue.oracle_sql()["e4_html_title"]).fetchall())
