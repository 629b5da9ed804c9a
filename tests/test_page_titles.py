"""Titles of odd pages, by the query and by its SQL."""

import __spark_entry__ as entry

PAGES = [
    (1, "http://h.example/a/last-part", "<html><head><title>Ende&amp;&amp;&amp</title></head><body>x</body></html>"),
    (2, "http://h.example/a", "<title>a &lt b &gt c &quot d&amplt; &amp;lt;</title>"),
    (3, "http://h.example/a/the_page/", "<title> \n </title><p>text</p>"),
    (4, "http://h.example", "<p>no title</p>"),
    (5, "http://h.example/null", None),
]


def test_titles_agree(spark, tmp_path):
    import duckdb

    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in entry.queries()["page_titles"](spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(connection.execute(entry.oracle_sql()["page_titles"]).fetchall())
    assert got == {(1, "Ende&&&"), (2, 'a < b > c " d&lt; &lt;'), (3, "The Page"), (4, "h.example"), (5, "Null")}
