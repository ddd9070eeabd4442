import pytest
from pyspark.sql import functions as F

from crawlframe.functions import classify, html, identity, text, urls
from crawlframe.functions.patterns import glob_to_regex


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "base", "expected"),
    [
        ("/x", "http://A.example:80/a/b?q#f", "http://a.example/x"), ("y", "http://a.example/a/b", "http://a.example/a/y"), ("../z", "http://a.example/a/b/c", "http://a.example/a/z"),
        ("?p=1", "http://a.example/a?q", "http://a.example/a?p=1"), ("//b.example", "https://a.example/", "https://b.example/"), ("#t", "http://a.example/a", "http://a.example/a#t"),
        ("", "http://a.example/a#b", "http://a.example/a"), ("a:b/c", "http://a.example/", None), ("mailto:x@y", "http://a.example/", None), ("/ü b", "http://a.example/", "http://a.example/%C3%BC%20b"),
    ],
)
def test_resolve(spark, raw, base, expected):
    assert value(spark, urls.resolve(F.col("raw"), F.col("base")), raw=raw, base=base) == expected


@pytest.mark.parametrize(
    ("strategy", "a", "b", "expected"),
    [
        ("all", "ftp://a.example/", "http://a.example/", False), ("same-hostname", "https://A.example:8080/", "http://a.example/", True), ("same-hostname", "http://b.a.example/", "http://a.example/", False),
        ("same-domain", "http://x.shop.co.uk/", "http://y.shop.co.uk/", True), ("same-domain", "http://x.co.uk/", "http://y.co.uk/", False), ("same-domain", "http://1.2.3.4/", "http://5.2.3.4/", False),
        ("same-origin", "http://a.example:80/", "http://a.example/", True), ("same-origin", "https://a.example/", "http://a.example/", False),
    ],
)
def test_strategies(spark, strategy, a, b, expected):
    assert value(spark, urls.strategy_allows(strategy, F.col("a"), F.col("b")), a=a, b=b) is expected


def test_identity(spark):
    assert value(spark, identity.request_id(F.col("k")), k="https://example.com/a") == "046a4934057f51cf316d82cd4a2217a5"
    assert value(spark, identity.unique_key(F.col("u"), F.lit("POST"), F.lit("")), u="http://a/#x") == "POST(cbf29ce484222325):http://a/"


def test_globs():
    import re

    assert re.search(glob_to_regex("**/products/*"), "http://a/products/x/y") and not re.search(glob_to_regex("*/p?"), "http://a/p")
    assert re.search(glob_to_regex("*.{jpg,png}"), "http://a/b.png") and re.search(glob_to_regex("*[!0-9]"), "x") and not re.search(glob_to_regex("*[!0-9]"), "1")
    with pytest.raises(ValueError):
        glob_to_regex("{a")


def test_error_key(spark):
    got = value(spark, text.error_key(F.col("e")), e="GET  https://a/1 id 123e4567-e89b-12d3-a456-426614174000 (https://a/1 E42\nnext")
    assert got == "GET <url> id <uuid> (https://a/# E#"


def test_classification(spark):
    codes = spark.createDataFrame([(c,) for c in (200, 301, 401, 404, 408, 503, 199)], "c int").select(classify.classify_status(F.col("c")).alias("v"))
    assert [r.v for r in codes.collect()] == ["success", "success", "session", "non_retryable", "retryable", "retryable", "non_retryable"]
    assert value(spark, classify.promotion(F.lit(200), F.col("h")), h="<body><script>x</script></body>") == "empty_body_likely_js"


def test_selectors():
    page = html.parse("<div id=a><p class='x y'>one<p>two<ul><li>1<li>2</ul></div><script>var t='</p>'</script><a href='/q'>z</a>")
    assert [n.text() for n in page.select("#a > p")] == ["one", "two"] and [n.text() for n in page.select("div li")] == ["1", "2"]
    assert page.first(".x.y").text() == "one" and page.select("a[href^='/']")[0].attrs["href"] == "/q" and len(page.select("li + li, script")) == 2
    with pytest.raises(ValueError):
        html.compiled("a:hover")
