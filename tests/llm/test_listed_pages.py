from helpers import assert_matches

from loomspark.llm import queries


def test_pages_are_listed_by_their_html_and_judged_by_their_canonical_url(spark, tmp_path):
    pages = [
        (0, "https://a.example.org/p?q=1", "Casino now"),
        (1, "HTTP://A.example.org/p#top", "same canonical url as a listed page"),
        (2, "https://a.example.org/other", "same host, not listed"),
        (3, "https://b.example.org/fr/x", "casino, but a rule allows it"),
        (4, "no scheme", "casino"),
        (5, None, "casino"),
        (6, "https://c.example.com/", None),
        (0, "https://a.example.org/p?q=1", "Casino now"),
    ]
    at = str(tmp_path)
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(at + "/pages.parquet")
    got = {(r.page_id, r.verdict) for r in queries.op5_url_filter(spark, at).collect()}
    assert got == {(0, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "allow")}


def test_op5_where_pages_are_listed(spark):
    assert_matches(spark, queries.QUERIES["op5_url_filter"], queries.ORACLE_SQL["op5_url_filter"], "/root/testdata/sf0.1")
