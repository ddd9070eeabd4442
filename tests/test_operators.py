import gzip
import math
from datetime import datetime

from pyspark.sql import functions as F

from crawlframe.functions.patterns import globs, regexes
from crawlframe.operators import http, links, queue, routing, sim
from crawlframe.operators.links import EnqueueSpec
from crawlframe.plans import crawl
from crawlframe.sources import sitemap, sites, store


def test_enqueue_chain(spark):
    raw = ["/products/one", "/products/one", "/products/two", "/news/keep", "/news/reject", "/ignored"]
    found = spark.createDataFrame([(1, "http://a.example/root", i, r, "http://a.example/root") for i, r in enumerate(raw)], "page_id int, src_url string, position int, raw string, base string")
    spec = EnqueueSpec(include=globs("**/products/*", label="P") + regexes("/news/(keep|reject)$"), exclude=globs("**/products/two"), transform=~F.col("url").endswith("reject"))
    got = {(r.url.rsplit("/", 1)[1], r.verdict, r.reason, r.label) for r in links.enqueue(links.resolve(found), spec).collect()}
    assert got == {("one", "added", None, "P"), ("two", "skipped", "glob_excluded", None), ("keep", "added", None, None), ("reject", "skipped", "transform_rejected", None), ("ignored", "skipped", "glob_excluded", None)}


def test_reach(spark):
    root = spark.range(1).select(F.col("id").alias("node"))
    assert {r.depth: r["count"] for r in crawl.reach(sites.tree(spark, 5), root).groupBy("depth").count().collect()} == {d: 2**d for d in range(5)}
    assert crawl.reach(sites.wide(spark, 20), root, 1).count() == 21


def test_crawl(spark):
    pages = sites.books(spark, 2, 2).select(F.concat(F.lit("https://s.example"), "url").alias("url"), F.lit(200).alias("status"), "html")
    seeds = spark.createDataFrame([("https://s.example/list/0",)], "url string")
    done = crawl.run(seeds, pages)
    assert done.requests.count() == 6 and done.requests.filter("outcome = 'succeeded'").count() == 6
    assert crawl.run(seeds, pages, crawl.CrawlSpec(max_requests=3)).requests.count() == 3
    assert crawl.run(seeds, pages, crawl.CrawlSpec(max_depth=0)).requests.count() == 1


def test_retries(spark):
    rows = [(1, None, False, 0, 0), (2, "retryable", False, 2, 0), (3, "retryable", False, 3, 0), (4, "session", False, 9, 9), (5, "force_retry", True, 9, 0), (6, "critical", False, 0, 0), (7, "retryable", True, 0, 0)]
    df = spark.createDataFrame(rows, "id int, error_class string, no_retry boolean, retry_count int, session_rotation_count int")
    got = {r.id: (r.next, r.retry_count, r.session_rotation_count) for r in http.next_state(df).collect()}
    assert got == {1: ("done", 0, 0), 2: ("retry", 3, 0), 3: ("failed", 3, 0), 4: ("retry", 9, 10), 5: ("retry", 10, 0), 6: ("aborted", 0, 0), 7: ("failed", 0, 0)}


def test_router(spark):
    same = lambda df: df
    r = routing.Router().route(same, "a").route(same, "a", "GET").default(same)
    assert r.shadowed() == [1]


def test_leases(spark):
    rows = [(1, datetime(2024, 1, 1), 0, 0), (2, None, 0, 0), (3, datetime(2025, 1, 1), 0, 0)]
    df = spark.createDataFrame(rows, "order_no long, lease_expires_at timestamp, retry_count int, session_rotation_count int")
    assert [r.order_no for r in queue.lease(df, 5, F.to_timestamp(F.lit("2024-06-01"))).collect()] == [1, 2]


def test_token_bucket(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("b", 0.0)], "k string, at double")
    got = sorted((r.k, r.at, r.granted, r.wait) for r in sim.token_bucket(df, "k", "at", 30).collect())
    assert [g[:3] for g in got] == [("a", 0.0, True), ("a", 1.0, False), ("a", 2.0, True), ("b", 0.0, True)] and math.isclose(got[1][3], 1.0)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a":1,"b":"plain"}'), (2, '{"b":"comma, and \\"quote\\"","c":true}')], "seq long, item string")
    store.export_csv(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().decode() == 'a,b,c\r\n1,plain,\r\n,"comma, and ""quote""",true'


def test_sitemap(spark):
    body = lambda s: gzip.compress(s.encode())
    rows = [("i", body("<sitemapindex><sitemap><loc>b</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>")), ("a", b"<urlset><url><loc>1</loc></url><url><loc>2</loc><priority>x</priority></url></urlset>"), ("b", b"<urlset><url><loc>3</loc></url><url><loc>1</loc></url><url><lo")]
    found = sitemap.expand(spark.createDataFrame([(0, "i")], "position int, url string"), spark.createDataFrame(rows, "url string, body binary"))
    assert [r.loc for r in found.orderBy("place").collect()] == ["3", "1"]


def test_csv_rows_hold_whole_texts(spark):
    import csv
    import io

    from crawlframe import queries

    d = "/root/testdata/sf0.001"
    lines = queries.dataset_csv_rows(spark, d).orderBy("seq").collect()
    got = [(r.seq, next(csv.reader(io.StringIO(r.line, newline="")))) for r in lines]
    rows = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    want = [(r.doc_id + 1, [str(r.doc_id), (r.lang or "") if r.doc_id % 3 == 0 else "", "" if r.n_chars is None else str(r.n_chars > 1000).lower(), r.text or ""]) for r in rows]
    assert got == want and any(len(r.text or "") > 40 for r in rows)
