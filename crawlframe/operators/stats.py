"""Crawl statistics: totals, histograms, error groups, windows, digests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import error_key

TERMINAL = ("succeeded", "failed")


def summary(attempts: DataFrame) -> DataFrame:
    """One row over attempts (request_id, duration, outcome: succeeded, failed or retried): counters and durations of finished requests.

    A request's duration is the sum over its attempts. The average is rounded down; 0 without any.
    """
    each = attempts.groupBy("request_id").agg(
        F.sum("duration").alias("total"), F.count_if(F.col("outcome") == "succeeded").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("bad"), F.count_if(F.col("outcome") == "retried").alias("again")
    )
    done = F.when((F.col("ok") > 0) | (F.col("bad") > 0), F.col("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return each.agg(
        zero(F.sum("ok")).alias("finished"), zero(F.sum("bad")).alias("failed"), zero(F.sum("again")).alias("retries"),
        zero(F.sum(done)).alias("total_duration"), F.min(done).cast("long").alias("min_duration"), F.max(done).cast("long").alias("max_duration"),
        zero(F.try_divide(F.sum(done), F.count(done)).cast("decimal(38,6)").cast("long")).alias("avg_duration"),
    )


def status_histogram(outcomes: DataFrame) -> DataFrame:
    """Successful requests by status."""
    return outcomes.filter("outcome = 'succeeded' AND status IS NOT NULL").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def retry_histogram(outcomes: DataFrame) -> DataFrame:
    """retry_count and n, dense from 0 to the largest count."""
    counts = outcomes.groupBy("retry_count").agg(F.count(F.lit(1)).alias("n"))
    dense = counts.agg(F.max("retry_count").alias("top")).filter("top IS NOT NULL").select(F.explode(F.expr("sequence(0, cast(top AS int))")).alias("retry_count"))
    return dense.join(counts, "retry_count", "left").select(F.col("retry_count").cast("long").alias("retry_count"), F.coalesce("n", F.lit(0)).alias("n"))


def error_groups(failures: DataFrame, error: str = "error") -> DataFrame:
    """Failures by normalised error."""
    return failures.groupBy(error_key(F.col(error)).alias("error_key")).agg(F.count(F.lit(1)).alias("n"))


def rates(events: DataFrame, key: str, seconds: int = 60, at: str = "ts") -> DataFrame:
    """events (outcome, ts) with finished_per_minute and failed_per_minute over the last `seconds`, both ends included.

    The window runs over one key's events (a crawl's, a shard's), so that no task holds them all.
    """
    frame = Window.partitionBy(key).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    rate = lambda o: (F.count_if(F.col("outcome") == o).over(frame) * 60 / seconds)
    return events.withColumn("finished_per_minute", rate("succeeded")).withColumn("failed_per_minute", rate("failed"))


def runtime(periods: DataFrame) -> DataFrame:
    """Total seconds of periods (started, stopped)."""
    return periods.agg(F.coalesce(F.sum(F.unix_timestamp("stopped") - F.unix_timestamp("started")), F.lit(0)).alias("seconds"))


def merge(states: DataFrame) -> DataFrame:
    """Saved summaries put together: sums, least and greatest durations."""
    total = [F.sum(c).alias(c) for c in ("finished", "failed", "retries", "total_duration")]
    out = states.agg(*total, F.min("min_duration").alias("min_duration"), F.max("max_duration").alias("max_duration"))
    return out.withColumn("avg_duration", F.coalesce(F.expr("try_divide(total_duration, finished + failed)").cast("long"), F.lit(0).cast("long")))


def md5_number(value: Column) -> Column:
    """63 bits of a value's md5, as a number."""
    return F.conv(F.left(F.md5(value.cast("string")), F.lit(15)), 16, 10).cast("long")


def digest(rows: DataFrame, value: Column) -> DataFrame:
    """A digest that doesn't depend on order: n, sum modulo 2^64, xor, and sum + rotl(xor, 17) modulo 2^64."""
    h = md5_number(value)
    two64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
    out = rows.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)) % two64).cast("decimal(38,0)").alias("total"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed"))
    high = F.expr("shiftrightunsigned(mixed, 47)").cast("decimal(38,0)")
    low = F.expr("mixed & 140737488355327").cast("decimal(38,0)") * F.lit(1 << 17)
    return out.withColumn("digest", ((F.col("total") + low + high) % two64).cast("decimal(38,0)"))


def site_totals(pages: DataFrame, body: str = "html") -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.octet_length(body).cast("long")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(md5_number(F.col(body)) % 1000003), F.lit(0)).alias("checksum"))


def hit_accounting(hits: DataFrame, site: DataFrame) -> DataFrame:
    """hits (host, path, own) against the site's paths: unique pages, duplicates, hits off the host and of unknown paths."""
    known = site.select("path").distinct().withColumn("_known", F.lit(True))
    met = hits.join(known, "path", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    each = met.groupBy("own", "_known", "path").agg(F.count(F.lit(1)).alias("n"))
    good = F.col("own") & F.col("_known")
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    return each.agg(total(good, F.lit(1)).alias("unique_pages"), total(good, F.col("n") - 1).alias("duplicates"), total(~F.col("own"), F.col("n")).alias("off_host"), total(F.col("own") & ~F.col("_known"), F.col("n")).alias("unknown"))


def terminal_rows(attempts: DataFrame, key: str = "request_id", order: str = "attempt") -> DataFrame:
    """One row for each request that ended: its first terminal attempt. Attempts that were retried give none."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return attempts.filter(F.col("outcome").isin(*TERMINAL)).withColumn("_n", first).filter("_n = 1").drop("_n")


def storage_samples(calls: DataFrame, signal: str = "storage") -> DataFrame:
    """Load samples (signal, at, overloaded) of storage calls (at, error_class): a call that succeeds is healthy, one that met a rate limit is overload; other errors say nothing."""
    said = calls.filter("error_class IS NULL OR error_class = 'rate_limited'")
    return said.select(F.lit(signal).alias("signal"), "at", F.col("error_class").isNotNull().alias("overloaded"))


def same_hits(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of hits are equal, repeats counted."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def report(trials: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, interquartile range, least and greatest value of trials by group; quantiles are interpolated."""
    q = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return trials.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.min(value).alias("least"), F.max(value).alias("most")).select(
        *by, "n", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "least", "most"
    )


def server_bound(trials: DataFrame, engine: str, value: str, baseline: str, share: float = 0.7) -> DataFrame:
    """Whether the fastest other engine reaches `share` of the baseline's best."""
    best = lambda c: F.max(F.when(c, F.col(value)))
    return trials.agg(best(F.col(engine) != baseline).alias("fastest"), best(F.col(engine) == baseline).alias("base")).withColumn("server_bound", F.col("fastest") >= share * F.col("base"))


def load_windows(samples: DataFrame, seconds: int = 300, most: int = 4096) -> DataFrame:
    """samples (signal, at, overloaded) of each signal's last `seconds`, at most `most` of them."""
    w = Window.partitionBy("signal")
    # The latest time of a signal is one number each: it is joined, not windowed over the signal's whole log.
    latest = samples.groupBy("signal").agg(F.max("at").alias("_t"))
    last = samples.join(latest, "signal").filter(F.col("at").cast("timestamp").cast("double") >= F.col("_t").cast("timestamp").cast("double") - seconds).drop("_t")
    return last.withColumn("_n", F.row_number().over(w.orderBy(F.desc("at")))).filter(F.col("_n") <= most).drop("_n")


def load_decision(samples: DataFrame, least: int = 1, target: float = 0.9) -> DataFrame:
    """down if any signal's last sample is overloaded; else up if the mean healthy share of signals with enough samples reaches the target; else hold."""
    each = samples.groupBy("signal").agg(F.max_by("overloaded", "at").alias("last"), F.avg((~F.col("overloaded")).cast("double")).alias("healthy"), F.count(F.lit(1)).alias("n"))
    out = each.agg(F.coalesce(F.max("last"), F.lit(False)).alias("over"), F.avg(F.when(F.col("n") >= least, F.col("healthy"))).alias("mean"))
    return out.select(F.when(F.col("over"), "down").when(F.col("mean") >= target, "up").otherwise("hold").alias("decision"), "mean")
