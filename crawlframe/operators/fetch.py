"""Fetching as a join with captured responses: redirects, coalescing, gates and promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import classify_status
from ..functions.text import is_html
from ..functions.urls import without_fragment


def fetch(requests: DataFrame, responses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """requests with their response by url without fragment; without one, error_class is retryable (no connection).

    A request meets each response captured of its url. by: columns of both that name a request's own response among those.
    """
    own = responses.withColumn("_k", without_fragment(F.col("url"))).drop("url").withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col("_q") == F.col("_k"), *[F.col(c) == F.col(f"_{c}") for c in by]]
    met = requests.withColumn("_q", without_fragment(F.col("url"))).join(own, same, "left")
    error = F.when(F.col("_k").isNull(), "retryable").otherwise(F.nullif(classify_status(F.col("status")), F.lit("success")))
    return met.withColumn("error_class", error).drop("_q", "_k", *[f"_{c}" for c in by])


def with_skips(requests: DataFrame, responses: DataFrame, skip: str = "skip_navigation", by: Sequence[str] = ()) -> DataFrame:
    """requests with their response, but for those that skip navigation: they pass as they are, without error. by: as for fetch."""
    passed = requests.filter(F.col(skip))
    return fetch(requests.filter(~F.coalesce(skip, F.lit(False))), responses, by).unionByName(passed, allowMissingColumns=True)


def rendered(requests: DataFrame, responses: DataFrame, pages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """requests (rendered) with their response: that of a browser (pages, the same columns as responses) where they are to be rendered, else the plain one. by: as for fetch."""
    plain = fetch(requests.filter("NOT rendered"), responses, by)
    return plain.unionByName(fetch(requests.filter("rendered"), pages, by))


def observe(fetched: DataFrame, session: Column | None = None, proxy: Column | None = None, body: str = "html") -> DataFrame:
    """What an attempt is known by: request, status, loaded url, session, proxy, bytes and error class."""
    none = F.lit(None).cast("string")
    return fetched.select(
        "unique_key", "status", F.col("url").alias("loaded_url"), (none if session is None else session).alias("session_id"), (none if proxy is None else proxy).alias("proxy"),
        F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("response_bytes"), "error_class",
    )


def hooked(pages: DataFrame, hooks: list, error: str = "error_class") -> DataFrame:
    """pages through navigation hooks in order. A hook is a function of the rows to a column: an error class, or null to go on; the first error of a row ends its hooks."""
    for hook in hooks:
        pages = pages.withColumn(error, F.when(F.col(error).isNull(), hook(pages)).otherwise(F.col(error)))
    return pages


def coalesced(requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests to send, one for each key, and how many share each: identical reads are fetched once. Others are sent each."""
    shared = F.col("method").isin("GET", "HEAD") & F.col("body").isNull()
    first = F.row_number().over(Window.partitionBy(*keys, "method").orderBy("seq"))
    sent = requests.withColumn("_s", shared).withColumn("_n", F.when(F.col("_s"), first).otherwise(1)).filter("_n = 1").drop("_s", "_n")
    counts = requests.filter(shared).groupBy(*keys, "method").agg(F.count(F.lit(1)).alias("waiting"))
    return sent, counts


def follow_redirects(starts: DataFrame, redirects: DataFrame, most: int = 10) -> DataFrame:
    """For each start (url, method): final_url, final_method, chain (without the final url), hops and status ok or too_many_redirects.

    redirects: src, dst, status. A loop of `most` + 1 self-joins over what is still moving. 303, and 301 and 302
    for methods other than GET and HEAD, go on as GET.
    """
    hop = redirects.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("status").alias("_code"))
    moving = starts.select("url", F.col("url").alias("final_url"), F.col("method").alias("final_method"), F.array().cast("array<string>").alias("chain"))
    done = None
    for _ in range(most + 1):
        met = moving.join(hop, moving["final_url"] == hop["_src"], "left")
        ended = met.filter("_dst IS NULL").drop("_src", "_dst", "_code").withColumn("status", F.lit("ok"))
        done = ended if done is None else done.unionByName(ended)
        get = (F.col("_code") == 303) | (F.col("_code").isin(301, 302) & ~F.col("final_method").isin("GET", "HEAD"))
        moving = met.filter("_dst IS NOT NULL").select(
            "url", F.col("_dst").alias("final_url"), F.when(get, "GET").otherwise(F.col("final_method")).alias("final_method"), F.array_append("chain", F.col("final_url")).alias("chain")
        )
    out = done.unionByName(moving.withColumn("status", F.lit("too_many_redirects")))
    return out.withColumn("hops", F.size("chain"))


def html_gate(responses: DataFrame) -> DataFrame:
    """responses with error_class non_retryable where the media type isn't HTML."""
    return responses.withColumn("error_class", F.when(~is_html(F.col("content_type")), "non_retryable"))


def sticky(promotions: DataFrame, host: str = "host", seq: str = "seq") -> DataFrame:
    """promotions (host, seq, promoted) with rendered: promoted, or an earlier request of the host was."""
    before = Window.partitionBy(host).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return promotions.withColumn("rendered", F.col("promoted") | F.coalesce(F.max("promoted").over(before), F.lit(False)))


def failure_artifacts(failures: DataFrame) -> DataFrame:
    """Key-value rows of failed pages' bodies: the same request overwrites its artifact."""
    key = F.concat(F.lit("ERROR_SNAPSHOT_"), F.left(F.md5("request_id"), F.lit(16)), F.lit(".html"))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("attempt")))
    rows = failures.withColumn("key", key).withColumn("_n", last).filter("_n = 1")
    return rows.select("key", F.col("body").alias("value"), F.lit("text/html").alias("content_type"), F.octet_length("body").cast("long").alias("size"))
