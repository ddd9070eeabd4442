"""Queries against their SQL over what the small tables don't have, as pages that share a url and long texts."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from crawlframe import oracle, queries
from crawlframe.functions import classify, html
from crawlframe.operators import http
from crawlframe.plans import crawl

#: Pages by id: twins of one url, twins but for the fragment, and a page alone.
URLS = {
    0: "http://a.example.com/en/1", 1: "http://a.example.com/en/1", 3: "https://b.example.net/en/2", 4: "https://b.example.net/en/2", 5: "https://c.example.org/en/3#top", 6: "https://c.example.org/en/3",
    7: "http://d.example.com/de/6", 9: "http://a.example.com/en/4", 10: "http://a.example.com/en/4", 15: "http://a.example.com/en/4#top", 20: "http://d.example.com/de/5", 25: "http://d.example.com/de/6",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("repeats"))
    rows = [(i, url, f"<html><head><title>Page {i}</title></head><body>{'x' * i}</body></html>") for i, url in URLS.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def agree(spark, d, name):
    """Rows of a query, which must be those of its SQL."""
    con = duckdb.connect()
    for path in Path(d).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    got = queries.QUERIES[name](spark, d)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({oracle.SQL[name]})").fetchall()
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want, key=str)
    return rows


def test_rendered_fetch(spark, tables):
    assert len(agree(spark, tables, "rendered_fetch")) == len(URLS)


def test_fetch_join(spark, tables):
    sizes = [r[1] for r in agree(spark, tables, "fetch_join") if r[0] == 2]
    assert len(sizes) == 2 and len(set(sizes)) == 2


def test_skip_navigation(spark, tables):
    assert len(agree(spark, tables, "skip_navigation")) == len(URLS)


def test_cookie_match(spark, tables):
    headers = dict(agree(spark, tables, "cookie_match"))
    assert headers[0] == headers[1] == "top=1; top=1" and headers[4] == "c3=3; c3=3" and headers[20] == "top=1"


def test_cookie_headers_hold_a_cookie_once(spark):
    asked = spark.createDataFrame([(1, "http://a.example/x"), (2, "http://a.example/x")], "id int, url string")
    cookies = spark.createDataFrame([("n", "v", "a.example", True, "/", False, None)], "name string, value string, domain string, host_only boolean, path string, secure boolean, expires timestamp")
    assert [r.cookie_header for r in http.cookie_headers(asked, cookies, F.current_timestamp()).collect()] == ["n=v", "n=v"]


def test_html_select_titles(spark, tmp_path):
    titles = ["a &lt;b&gt; &amp;lt; &amp;amp; c", "cut &amp;&amp", "&quot;q&quot; &nbsp;&#65; &copy &eacute;t&eacute;", "&&& & &", ""]
    rows = [(i, f"<html><head><meta name='a&amp;b'><title>{t}</title></head><body><title>no</title></body></html>") for i, t in enumerate(titles)]
    rows += [(5, "<html><head></head><body>none</body></html>"), (6, None), (7, "<head><script>if (a && b &amp;&amp; c) {}</script><title>&lt;after&amp</title></head>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert dict(agree(spark, tmp_path, "html_select_titles"))[1] == "cut &&amp"


def test_text_as_written():
    page = html.parse("<p title='a&amp;b'>x &amp; &quot;y&amp</p><script>a && b &amp;</script>", written=True)
    assert [n.text() for n in page.walk()] == ["x &amp; &quot;y&amp", "a && b &amp;"] and page.first("p").attrs["title"] == "a&amp;b"


def test_crawl_failures(spark, tables):
    urls = [r[0] for r in agree(spark, tables, "crawl_failures")]
    assert sorted(urls) == sorted(url for i, url in URLS.items() if i % 5 == 0)


def test_seeds_with_keys_of_their_own(spark):
    links = "<a href=\"/next\">n</a>"
    seeds = spark.createDataFrame([("http://a.example/x", "one"), ("http://a.example/x", "two"), ("http://a.example/x#top", None), ("http://a.example/x", None)], "url string, unique_key string")
    pages = spark.createDataFrame([("http://a.example/x", 200, links), ("http://a.example/next", 404, "")], "url string, status int, html string")
    done = crawl.run(seeds, pages)
    assert sorted((r.unique_key, r.depth, r.outcome) for r in done.requests.collect()) == [("http://a.example/next", 1, "failed"), ("http://a.example/x", 0, "succeeded"), ("one", 0, "succeeded"), ("two", 0, "succeeded")]


def test_antibot_detect(spark, tmp_path):
    long = "Wort für Wort " * 6000
    texts = ["GNU General", long, long + "DataDome", "thth " + long + "gnu general", long + "captcha " + long + "Access Denied", None, "", "x" * 65530 + "kasada"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [vendor for _, vendor in agree(spark, tmp_path, "antibot_detect")] == ["gnu", None, "datadome", "gnu", "unknown", None, None, "kasada"]


def test_detector_keeps_its_limit(spark):
    seen = spark.createDataFrame([("x" * 65530 + "datadome",), ("x" * 65528 + "datadome",)], "body string").select(classify.anti_bot(F.col("body")).alias("v"))
    assert [r.v for r in seen.collect()] == [None, "datadome"]
