"""Links of pages: extraction, resolution and the filter chain that turns them into requests.

Every candidate ends in one row of the result: added, or skipped for one reason. The order of the
filters is part of the meaning: invalid url, strategy, exclude, include, then, without a row, repeats
within a page and the page's limit, then depth, duplicates of known keys and the crawl's budget.
Of urls found by several pages the first page's counts, by page order and position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.identity import get_key
from ..functions.patterns import Pattern, exclusion, include_reason, included, override

HREF = r"<a\s[^>]*?\bhref=\"([^\"]*)\""
BASE = r"<base\s[^>]*?\bhref=\"([^\"]*)\""


@dataclass(frozen=True)
class EnqueueSpec:
    """Options of one enqueue call."""

    strategy: str = "same-hostname"
    include: list[Pattern] = field(default_factory=list)
    exclude: list[Pattern] = field(default_factory=list)
    label: str | None = None
    limit: int | None = None
    depth: int = 1
    max_depth: int | None = None
    budget: int | None = None
    transform: Column | None = None  # false rejects the candidate
    rewrite: Column | None = None  # struct (keep, url, unique_key): the candidate as a user's code changed it; a null key is made anew
    forefront: bool = False


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Rows (key, src_url, position, raw, base) of the anchors of pages; base is the first usable <base>, else the page."""
    first = urls.let(F.regexp_extract(html, BASE, 1), lambda b: F.when(b != "", urls.resolve(b, F.col(url))))
    base = F.coalesce(first, F.col(url))
    found = pages.select(key, F.col(url).alias("src_url"), base.alias("base"), F.posexplode(F.regexp_extract_all(html, F.lit(HREF), 1)).alias("position", "raw"))
    return found.select(key, "src_url", "position", "raw", "base")


def with_explicit(links: DataFrame, explicit: DataFrame, key: str = "page_id") -> DataFrame:
    """Explicit candidates (key, src_url, position, raw, base) before extracted ones; strategies don't apply to them."""
    shift = explicit.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    moved = links.join(shift, key, "left").withColumn("position", F.col("position") + F.coalesce("_n", F.lit(0))).drop("_n")
    return moved.withColumn("apply_strategy", F.lit(True)).unionByName(explicit.withColumn("apply_strategy", F.lit(False)))


def resolve(links: DataFrame) -> DataFrame:
    """links with url, the resolved candidate; null if it can't be resolved."""
    return links.withColumn("url", urls.resolve(F.col("raw"), F.col("base")))


def decide(links: DataFrame, spec: EnqueueSpec) -> DataFrame:
    """links with `reason` of the filters that look at one candidate alone; null for those that pass."""
    url, parent = F.col("url"), F.col("src_url")
    outside = ~urls.strategy_allows(spec.strategy, url, parent)
    if "apply_strategy" in links.columns:
        outside = outside & F.col("apply_strategy")
    reason = F.when(url.isNull(), "invalid_url").when(outside, "strategy_excluded")
    if spec.exclude:
        links, excluded = links.withColumn("_excluded", exclusion(url, spec.exclude)), F.col("_excluded")
        reason = reason.when(excluded.isNotNull(), excluded)
    if spec.include:
        reason = reason.when(~included(url, spec.include), include_reason(spec.include))
    out = links.withColumn("reason", reason)
    label = override(url, spec.include, "label", F.lit(spec.label).cast("string"))
    return out.withColumn("label", F.when(F.col("reason").isNull(), label)).drop("_excluded")


def enqueue(links: DataFrame, spec: EnqueueSpec, key: str = "page_id", known: DataFrame | None = None) -> DataFrame:
    """The result of one call over resolved links: key, position, url, unique_key, label, depth, verdict, reason.

    known: unique keys already in the queue. Candidates that were refused go along with the others, so that pages are
    read once. Windows run over a page or a unique key; only the budget, where one is set, orders all added rows, and
    then those up to the budget alone.
    """
    rows = decide(links, spec).withColumn("_open", F.col("reason").isNull())
    first = F.row_number().over(Window.partitionBy(key, "url", "_open").orderBy("position"))
    rows = rows.withColumn("_n", first).filter("NOT _open OR _n = 1")
    if spec.limit is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_open").orderBy("position"))).filter(~F.col("_open") | (F.col("_n") <= spec.limit))
    rows = rows.withColumn("unique_key", F.when(F.col("_open"), get_key(F.col("url"))))
    late = F.lit(None).cast("string")
    if spec.max_depth is not None and spec.depth > spec.max_depth:
        late = F.lit("max_depth_exceeded")
    elif spec.transform is not None:
        late = F.when(~spec.transform, "transform_rejected")
    elif spec.rewrite is not None:
        # The key follows the changed url unless the user's code set a key of its own.
        rows = rows.withColumn("_r", F.when(F.col("_open"), spec.rewrite)).withColumn("url", F.coalesce("_r.url", "url"))
        rows = rows.withColumn("unique_key", F.when(F.col("_open"), F.coalesce("_r.unique_key", get_key(F.col("url")))))
        late = F.when(~F.coalesce("_r.keep", F.lit(True)), "transform_rejected")
    rows = rows.withColumn("reason", F.coalesce("reason", late))
    # Refused candidates have no key; a number of their own spreads them, and meets no key of the queue.
    rows = rows.withColumn("_k", F.coalesce("unique_key", F.concat(F.lit("\x00"), F.xxhash64(key, "position").cast("string"))))
    rank = F.row_number().over(Window.partitionBy("_k", F.col("reason").isNull()).orderBy(key, "position"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (rank > 1), "duplicate_unique_key").otherwise(F.col("reason")))
    if known is not None:
        seen = known.select(F.col("unique_key").alias("_k")).distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(seen, "_k", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_seen"), "duplicate_unique_key")))
    if spec.budget is not None:
        rows = within_budget(rows, spec.budget, key)
    verdict = F.when(F.col("reason").isNull(), "added").otherwise("skipped").alias("verdict")
    return rows.select(key, "position", "url", "unique_key", "label", F.lit(spec.depth).alias("depth"), verdict, "reason")


def within_budget(rows: DataFrame, budget: int, key: str) -> DataFrame:
    """rows of which at most `budget` stay without reason, the first by (key, position); the others exceed the budget.

    The admitted rows are found by a distributed top-k, the rest by not being among them.
    """
    free = rows.filter("reason IS NULL").orderBy(key, "position").limit(budget).select(F.col(key).alias("_a"), F.col("position").alias("_b"))
    met = rows.join(free, (rows[key] == free["_a"]) & (rows["position"] == free["_b"]), "left")
    return met.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_a").isNull(), "max_requests_reached").otherwise(F.col("reason"))).drop("_a", "_b")


def counts(result: DataFrame) -> DataFrame:
    """Rows of a result by verdict and reason."""
    return result.groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


def titles(pages: DataFrame) -> DataFrame:
    """page_id, url and title of pages, the title's text trimmed; null without one."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", "url", F.nullif(F.btrim(title), F.lit("")).alias("title"))
