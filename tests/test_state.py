import json
import os

import pytest
from pyspark.sql import functions as F

from crawlframe import config
from crawlframe.functions import identity
from crawlframe.operators import fetch, http, links, queue, sim
from crawlframe.operators.links import EnqueueSpec
from crawlframe.plans import crawl
from crawlframe.sources import sites, store


def test_config():
    got = config.resolve({"max_retries": 5}, {"CRAWLFRAME_MEMORY_MIB": "4", "CRAWLFRAME_PURGE_ON_START": "0", "CRAWLFRAME_LOG_LEVEL": "WARN", "CRAWLFRAME_MAX_CONCURRENCY": "7"})
    assert (got.max_retries, got.memory_bytes, got.purge_on_start, got.log_level, got.max_concurrency) == (5, 4 << 20, False, "warn", 7)
    assert config.resolve({"log_level": "off"}, {"CRAWLFRAME_LOG_LEVEL": "warn"}).log_level == "off" and config.resolve({}, {}) == config.Config()
    for given, environment in (({"nope": 1}, {}), ({}, {"CRAWLFRAME_PURGE_ON_START": "maybe"}), ({}, {"CRAWLFRAME_MEMORY_MIB": str(1 << 50)}), ({"min_concurrency": 0}, {}), ({"min_concurrency": 9, "max_concurrency": 8}, {}), ({"idle_seconds": 0}, {})):
        with pytest.raises(ValueError):
            config.resolve(given, environment)


def test_state_outlives_a_broken_write(spark, tmp_path):
    held = store.Storage(spark, f"file://{tmp_path}")
    state = held.state("n long, name string", (0, "new"))
    state.update(lambda v: (v[0] + 2, "kept"))
    state.persist()
    os.makedirs(tmp_path / "states/default/version=9")  # begun, never finished
    again = held.state("n long, name string", (0, "new"))
    assert again.get() == (2, "kept")
    again.set((3, "kept"))
    again.persist()
    assert held.state("n long, name string", (0, "new")).get() == (3, "kept")
    for name in ("", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            held.state("n long", (0,), name)


def test_named_datasets(spark, tmp_path):
    held = store.Storage(spark, f"file://{tmp_path}")
    items = spark.createDataFrame([(i, json.dumps({"i": i})) for i in range(5)], "i int, item string")
    held.push(items.filter("i < 3"), ["i"])
    held.push(items.filter("i >= 3"), ["i"])
    held.push(items, ["i"], "other")
    assert [r.seq for r in held.dataset().orderBy("seq").collect()] == [1, 2, 3, 4, 5] and held.dataset("other").count() == 5
    assert list(store.stream(held.dataset(), 1, 2, desc=True)) == ['{"i": 3}', '{"i": 2}']


def test_atomic_export(spark, tmp_path):
    path = str(tmp_path / "out.json")
    with pytest.raises(RuntimeError), store.atomic(path) as f:
        f.write("half")
        raise RuntimeError
    assert os.listdir(tmp_path) == []
    store.export_json(spark.createDataFrame([(1, '{"a":1}')], "seq long, item string"), path)
    assert json.loads(open(path).read()) == [{"a": 1}] and os.listdir(tmp_path) == ["out.json"]
    names = spark.createDataFrame([(".out.json." + "0" * 32 + ".tmp",), ("out.json",)], "n string")
    assert [r[0] for r in names.select(store.is_temporary(F.col("n"))).collect()] == [True, False]


def test_bodies_in_chunks(spark, tmp_path):
    (tmp_path / "a").write_bytes(bytes(range(256)) * 10)
    (tmp_path / "b").write_bytes(b"")
    got = store.read_bodies(spark, f"file://{tmp_path}", 1000).orderBy("path", "position").collect()
    assert b"".join(bytes(r.bytes) for r in got) == bytes(range(256)) * 10 and [r.position for r in got] == [0, 1000, 2000]


def test_rewrites(spark):
    found = spark.createDataFrame([(1, "http://a.example/", i, f"http://a.example/{p}") for i, p in enumerate(("one", "two", "own", "gone"))], "page_id int, src_url string, position int, url string")
    change = F.struct(~F.col("url").endswith("gone") | F.lit(False), F.regexp_replace("url", "two$", "one"), F.when(F.col("url").endswith("own"), "mine")).cast("struct<keep: boolean, url: string, unique_key: string>")
    got = [(r.url[-3:], r.unique_key[-4:], r.reason) for r in links.enqueue(found, EnqueueSpec(rewrite=change)).orderBy("position").collect()]
    assert got == [("one", "/one", None), ("one", "/one", "duplicate_unique_key"), ("own", "mine", None), ("one", "gone", "transform_rejected")]


def test_callbacks_and_drain(spark):
    pages = sites.books(spark, 2, 2).select(F.concat(F.lit("https://s.example"), "url").alias("url"), F.when(F.col("url") == "/book/1", 404).otherwise(200).alias("status"), "html")
    seeds = spark.createDataFrame([("https://s.example/list/0",)], "url string")
    spec = crawl.CrawlSpec(failed=lambda rows: rows.select("url", "error_class"), skipped=lambda rows: rows.groupBy("reason").count())
    done = crawl.run(seeds, pages, spec)
    assert [tuple(r) for r in done.failures.collect()] == [("https://s.example/book/1", "non_retryable")] and done.skips is not None and done.pending.count() == 0
    assert done.requests.groupBy("unique_key").count().filter("count > 1").count() == 0
    stopped = crawl.run(seeds, pages, crawl.CrawlSpec(stop=lambda wave, n: True))
    assert stopped.requests.count() == 1 and stopped.pending.count() == 3


def test_retry_strategy_and_limits(spark):
    df = spark.createDataFrame([(1, "retryable", False, 3, 0, 9), (2, "retryable", False, 0, 0, 0), (3, "non_retryable", False, 0, 0, 3), (4, "critical", False, 0, 0, 3)], "id int, error_class string, no_retry boolean, retry_count int, session_rotation_count int, most int")
    got = {r.id: r.next for r in http.next_state(df, F.col("most"), strategy=lambda d: F.when(F.col("id") >= 3, True)).collect()}
    assert got == {1: "retry", 2: "failed", 3: "retry", 4: "aborted"}


def test_user_data_and_sessions(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":[1,2]}}',), (None,), ('{"label":"old"}',)], "d string")
    got = [json.loads(r[0]) for r in df.select(http.with_user_data(F.col("d"), "label", F.lit("new"))).collect()]
    assert got == [{"a": 1, "b": {"c": [1, 2]}, "label": "new"}, {"label": "new"}, {"label": "new"}]
    sessions = spark.createDataFrame([("s1", 0.5, 3, "2030-01-01 00:00:00"), ("s2", 0.5, 3, "2020-01-01 00:00:00")], "id string, error_score double, usage_count long, at string").select("id", "error_score", "usage_count", F.to_timestamp("at").alias("expires_at"))
    kept = http.saved(sessions).unionByName(spark.createDataFrame([("SESSION_x", "{not json")], "key string, value string"))
    assert [r.id for r in http.restored(kept, F.to_timestamp(F.lit("2025-01-01"))).collect()] == ["s1"]


def test_hooks_and_rendered(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "retryable")], "id int, error_class string")
    got = {r.id: r.error_class for r in fetch.hooked(df, [lambda d: F.when(F.col("id") == 1, "session"), lambda d: F.lit("critical")]).collect()}
    assert got == {1: "session", 2: "critical", 3: "retryable"}


def test_abort_and_overrides(spark):
    q = spark.createDataFrame([(1, "leased"), (2, "pending"), (3, "handled")], "order_no long, status string")
    assert sorted(map(tuple, queue.abort(q, F.lit(7)).collect())) == [(-7, "pending"), (2, "pending"), (3, "handled")]


def test_folds_keep_states_by_key(spark):
    rows = [(k, i, i % 3 != 0) for k in range(40) for i in range(50)] + [(None, 0, True)]
    got = {r.k: r.desired for r in sim.aimd(spark.createDataFrame(rows, "k long, i long, ok boolean"), "k", ["i"], streak=2).collect()}
    assert len(got) == 41 and len({v for k, v in got.items() if k is not None}) == 1 and got[None] == 10


def test_splitmix(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (-1,)], "s long").select(identity.splitmix64(F.col("s"))).collect()]
    assert got[0] == "e220a8397b1dcdaf"


def test_state_follows_a_stream(spark, tmp_path):
    from crawlframe.streaming import live

    spark.range(5).write.parquet(str(tmp_path / "in"))
    state = store.State(spark, f"file://{tmp_path}/state", "n long", (0,))
    query = live.persist_every(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), state, lambda old, batch: (old[0] + batch.count(),), str(tmp_path / "checkpoint"), "0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert store.State(spark, f"file://{tmp_path}/state", "n long", (0,)).get() == (5,)
