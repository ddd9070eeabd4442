"""The crawl as a fixpoint: frontier, fetch, links, unseen requests, and again until nothing new is left."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import get_key
from ..functions.urls import normalise
from ..operators import links as link_ops
from ..operators.fetch import fetch
from ..operators.links import EnqueueSpec


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named (local mode, in tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="crawlframe-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


class Waves:
    """A table of waves in the shared folder: each wave is written once and read again, so plans stay short."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", None

    def add(self, df: DataFrame, wave: int) -> DataFrame:
        self.schema = df.schema
        df.write.parquet(f"{self.path}/wave={wave}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/wave={wave}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/wave=*")


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node and depth of all nodes reachable from roots (node) over edges (src, dst), least depth first.

    A wave's new nodes are the distinct targets less all nodes reached before, by an anti-join.
    """
    waves = Waves(edges.sparkSession, "reach")
    frontier = waves.add(roots.select("node").distinct().withColumn("depth", F.lit(0)), 0)
    depth = 0
    while (max_depth is None or depth < max_depth) and frontier.limit(1).count():
        depth += 1
        found = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = waves.add(found.join(waves.all().select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), depth)
    return waves.all()


@dataclass(frozen=True)
class CrawlSpec:
    """What a crawl follows, and how far."""

    enqueue: EnqueueSpec = field(default_factory=EnqueueSpec)
    max_depth: int | None = None
    max_requests: int | None = None
    max_waves: int = 1000
    handler: Callable[[DataFrame], DataFrame] | None = None  # pages to records
    failed: Callable[[DataFrame], DataFrame] | None = None  # requests that failed for good, to rows
    skipped: Callable[[DataFrame], DataFrame] | None = None  # links that were skipped, with reason, to rows
    stop: Callable[[int, int], bool] | None = None  # given the wave and its requests, whether to stop after it (a drain: the wave is whole)


@dataclass
class Crawl:
    """The tables a crawl leaves: requests (with depth and status), the verdicts on links, and records."""

    requests: DataFrame
    verdicts: DataFrame
    records: DataFrame | None
    failures: DataFrame | None = None
    skips: DataFrame | None = None
    pending: DataFrame | None = None  # admitted but not fetched, after a stop


def requests_of(seeds: DataFrame) -> DataFrame:
    """Start requests of a column url: normalised, keyed (by the seeds' own unique_key, where they have one), one for each key; urls that aren't http(s) go."""
    key = F.coalesce("unique_key", get_key(F.col("url"))) if "unique_key" in seeds.columns else get_key(F.col("url"))
    return seeds.withColumn("url", normalise(F.col("url"))).filter("url IS NOT NULL").select("url", key.alias("unique_key")).dropDuplicates(["unique_key"]).withColumn("depth", F.lit(0))


def run(seeds: DataFrame, responses: DataFrame, spec: CrawlSpec = CrawlSpec()) -> Crawl:
    """Crawl captured responses (url, status, html) from seeds (url).

    Seeds may bring a unique_key of their own, so that several requests go to one url. Where responses have a column unique_key,
    too, each answers the request of that key alone.
    Requests are admitted in the order of waves, and within one by the linking page's key and position; only new
    requests count against max_requests.
    """
    spark = seeds.sparkSession
    seen, judged = Waves(spark, "requests"), Waves(spark, "verdicts")
    start = requests_of(seeds).orderBy("unique_key")
    frontier = start if spec.max_requests is None else start.limit(spec.max_requests)
    left, by = spec.max_requests, [c for c in responses.columns if c == "unique_key"]
    for wave in range(spec.max_waves):
        fetched = seen.add(fetch(frontier, responses, by).select("url", "unique_key", "depth", "status", "error_class", "html"), wave)
        n = fetched.count()
        if not n:
            break
        left = None if left is None else left - n
        pages = fetched.filter("error_class IS NULL")
        found = link_ops.resolve(link_ops.extract(pages, key="unique_key")).withColumnRenamed("unique_key", "page")
        options = replace(spec.enqueue, depth=wave + 1, max_depth=spec.max_depth, budget=left)
        result = judged.add(link_ops.enqueue(found, options, key="page", known=seen.all().select("unique_key")), wave)
        frontier = result.filter("verdict = 'added'").select("url", "unique_key", "depth")
        if spec.stop and spec.stop(wave, n):
            break
    all_requests = seen.all()
    done = all_requests.withColumn("outcome", F.when(F.col("error_class").isNull(), "succeeded").otherwise("failed"))
    records = spec.handler(done.filter("outcome = 'succeeded'")) if spec.handler else None
    failures = spec.failed(done.filter("outcome = 'failed'")) if spec.failed else None
    skips = spec.skipped(judged.all().filter("verdict = 'skipped'")) if spec.skipped else None
    return Crawl(done.drop("html"), judged.all(), records, failures, skips, frontier.join(all_requests.select("unique_key"), "unique_key", "left_anti"))
