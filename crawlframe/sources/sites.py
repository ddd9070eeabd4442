"""Generated sites for crawls and benchmarks, as edges (src, dst) of page numbers and as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRIDES = (3271, 5501, 6151, 7013, 7919, 4099, 2003)


def tree(spark: SparkSession, depth: int = 13) -> DataFrame:
    """A binary tree of 2^depth - 1 pages; each page links its children and the root."""
    n = (1 << depth) - 1
    out = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(2 * F.col("id") + 1, 2 * F.col("id") + 2, F.lit(0).cast("long"))).alias("dst"))
    return out.filter(F.col("dst") < n)


def wide(spark: SparkSession, leaves: int = 5000) -> DataFrame:
    """A root with many leaves."""
    return spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))


def mesh(spark: SparkSession, n: int = 8192) -> DataFrame:
    """Page i links i + 1 and, by seven strides, larger pages."""
    steps = [F.col("id") + 1] + [(F.col("id") * p + k + 1) % n for k, p in enumerate(STRIDES)]
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*steps)).alias("dst")).filter("dst > src").filter(F.col("dst") < n)


def redirects(spark: SparkSession, depth: int = 11) -> DataFrame:
    """Each page of a tree behind one redirect: src, dst, status."""
    return spark.range((1 << depth) - 1).select(F.format_string("/r/%d", "id").alias("src"), F.format_string("/p/%d", "id").alias("dst"), F.lit(302).alias("status"))


def books(spark: SparkSession, listings: int = 100, each: int = 50) -> DataFrame:
    """Books of a shop: page (url, html) of every listing and every detail page."""
    price = F.format_string("£%d.%02d", F.expr("(199 + (id * 7919 % 4801)) div 100"), F.expr("(199 + (id * 7919 % 4801)) % 100"))
    item = F.concat(F.lit('<html><body><h1>Book '), F.col("id"), F.lit('</h1><p class="price_color">'), price, F.lit('</p><p class="instock availability"> In stock </p></body></html>'))
    details = spark.range(listings * each).select(F.format_string("/book/%d", "id").alias("url"), item.alias("html"))
    link = F.transform(F.expr(f"sequence(id * {each}, id * {each} + {each - 1})"), lambda b: F.format_string('<article class="product_pod"><h3><a href="/book/%d">Book %d</a></h3></article>', b, b))
    after = F.when(F.col("id") + 1 < listings, F.format_string('<ul class="pager"><li><a href="/list/%d">next</a></li></ul>', F.col("id") + 1)).otherwise("")
    lists = spark.range(listings).select(F.format_string("/list/%d", "id").alias("url"), F.concat(F.lit("<html><body>"), F.array_join(link, ""), after, F.lit("</body></html>")).alias("html"))
    return lists.unionByName(details)
