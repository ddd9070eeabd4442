"""Sitemaps: tolerant XML, gzip, nested indexes in document order, limits and resumption."""

from __future__ import annotations

import gzip
import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.crawl import Waves
from ..schema import SITEMAP_ENTRIES

MOST_DEPTH = 5
ENTRY = T.StructType([T.StructField("kind", T.StringType()), *SITEMAP_ENTRIES.fields])


def unpack(body: bytes, url: str) -> bytes:
    """The body, decompressed where its name or first bytes say gzip; members one after the other."""
    if url.split("?")[0].endswith(".gz") or body[:2] == b"\x1f\x8b":
        return gzip.decompress(body)
    return body


def entries(body: bytes) -> tuple[list[dict], bool]:
    """url and sitemap entries of a document, and whether it was read to its end. Entries without loc, or with a bad priority, are left out."""
    out: list[dict] = []
    stack: list[str] = []
    now: dict = {}
    parser = expat.ParserCreate()

    def start(name, _):
        stack.append(name.rpartition(":")[2].lower())
        if len(stack) == 2:
            now.clear()

    def data(text):
        if len(stack) == 3 and stack[0] in ("urlset", "sitemapindex"):
            now[stack[2]] = now.get(stack[2], "") + text

    def end(_):
        if len(stack) == 2 and (stack[0], stack[1]) in (("urlset", "url"), ("sitemapindex", "sitemap")):
            e = {k: v.strip() for k, v in now.items()}
            try:
                priority = float(e["priority"]) if e.get("priority") else None
            except ValueError:
                e = {}
            if e.get("loc"):
                out.append({"kind": stack[1], "loc": e["loc"], "lastmod": e.get("lastmod"), "priority": priority, "changefreq": e.get("changefreq")})
        stack.pop()

    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, data, end
    try:
        parser.Parse(body, True)
        return out, True
    except expat.ExpatError:
        return out, False


@F.pandas_udf(T.StructType([T.StructField("entries", T.ArrayType(ENTRY)), T.StructField("whole", T.BooleanType())]))
def parsed(bodies: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """Entries of each body; null entries where it is missing or can't be unpacked."""
    rows = []
    for body, url in zip(bodies, urls):
        try:
            found, whole = (None, False) if body is None else entries(unpack(bytes(body), url or ""))
        except (OSError, EOFError, zlib.error):
            found, whole = None, False
        rows.append((found, whole))
    return pd.DataFrame(rows, columns=["entries", "whole"])


def expand(roots: DataFrame, bodies: DataFrame, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Entries (place, loc, lastmod, priority, changefreq, sitemap) reached from roots (position, url), each loc once, depth first.

    bodies: url, body. Indexes nest MOST_DEPTH deep; each sitemap is read once, where it first comes. `place` is
    an array of positions, by which the entries are in order. skip: entries emitted before an interruption.
    """
    at = lambda *c: F.array(*[x.cast("long") for x in c])
    level = roots.select(at(F.col("position")).alias("place"), F.col("url"))
    known, found = None, None
    # Each level is written once and read again, so the next level's plan starts there.
    maps, read_rows = Waves(roots.sparkSession, "sitemaps"), Waves(roots.sparkSession, "sitemap-rows")
    for depth in range(MOST_DEPTH + 1):
        first = Window.partitionBy("url").orderBy("place")
        level = level.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        if known is not None:
            level = level.join(known, "url", "left_anti")
        level = maps.add(level, depth)
        if depth and not level.limit(1).count():
            break
        known = level.select("url") if known is None else known.unionByName(level.select("url"))
        read = level.join(bodies, "url").withColumn("_p", parsed(F.col("body"), F.col("url"))).select("place", "url", F.posexplode("_p.entries").alias("_i", "_e"))
        rows = read.select(F.concat("place", at(F.col("_i"))).alias("place"), F.col("url").alias("sitemap"), "_e.*")
        rows = read_rows.add(rows, depth)
        mine = rows.filter("kind = 'url'").drop("kind")
        found = mine if found is None else found.unionByName(mine)
        level = rows.filter("kind = 'sitemap'").select("place", F.col("loc").alias("url"))
    out = found.withColumn("_n", F.row_number().over(Window.partitionBy("loc").orderBy("place"))).filter("_n = 1").drop("_n")
    if limit is not None or skip:
        out = out.orderBy("place").offset(skip)
        out = out if limit is None else out.limit(limit)
    return out


def failures(roots: DataFrame, bodies: DataFrame) -> DataFrame:
    """status of each root: read, broken (some entries) or failed (no body); all failed means the crawl has no source."""
    met = roots.join(bodies, "url", "left").withColumn("_p", parsed(F.col("body"), F.col("url")))
    return met.select("url", F.when(F.col("_p.entries").isNull(), "failed").when(~F.col("_p.whole"), "broken").otherwise("read").alias("status"))
