"""Quality rules by host, with DataFrame operations only.

Base rules judge each document. Their failures are counted by host (here: `source`), each
host's failure rate is shrunk towards a beta prior fitted to all hosts by moments, and a host
whose shrunk rate is above `most` loses its documents.

Edge cases: null and empty texts have no words, so they fail; a null source is a host of its
own; repeated rows count each; very long texts are measured whole; equal rates are judged alike, so ties need no order;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, settle, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Number of words in windows of `window` words that occur twice or more in the array w.

    Windows are compared by 64-bit hash. Only a document whose hashes aren't distinct is sorted.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            hit = F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"])))
            at = F.sort_array(F.transform(hit, lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("p"))
            return F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["p"])).alias("n"), p.alias("p")))["n"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, twice))

    def of(own: Column) -> Column:
        hashed = F.transform(own, lambda x: F.xxhash64(x))
        spans = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[h[i + j] for j in range(window)]))
        return F.when(F.size(own) < window + 1, F.lit(0)).otherwise(_let(_let(hashed, spans), covered))

    return _let(w, of).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of the base rules for each row of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return docs.select(
        "doc_id", "source", words(F.col("text")).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("w")).alias("n_repeat_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """One row for each source: n, failed, rate (shrunk), alpha, beta.

    The prior beta(alpha, beta) has the mean and variance of the hosts' own rates, each host weighing
    one; where hosts vary too little or too much for a beta distribution, it has the mean and 2 to
    1000 documents' weight.
    """
    hosts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = hosts.withColumn("own", F.col("failed") / F.col("n"))
    prior = hosts.agg(F.avg("own").alias("m"), F.coalesce(F.var_pop("own"), F.lit(0.0)).alias("v"))
    weight = F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(1000.0))
    m, k = prior.select("m", F.least(F.greatest(weight, F.lit(2.0)), F.lit(1000.0)).alias("k")).first()
    m, k = F.lit(m).cast("double"), F.lit(k).cast("double")  # two numbers, whatever the number of hosts
    alpha, beta = m * k, (1 - m) * k
    return hosts.select("source", "n", "failed", alpha.alias("alpha"), beta.alias("beta"), ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("rate"))


def judge(docs: DataFrame, least_words: int = 20, most_repeats: int = 30, most: float = 0.5, salt: int = 16) -> DataFrame:
    """The counts, base_failed, host_rate and kept for each row of documents."""
    counted = measures(docs)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    judged = settle(counted.withColumn("base_failed", failed), "judged")
    hosts = host_rates(judged).select(F.col("source").alias("_s"), F.col("rate").alias("host_rate"))
    # Verdicts go back by a join that Spark broadcasts only if it measures the hosts to be few; otherwise salt spreads a hot host.
    hosts = hosts.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    judged = judged.withColumn("_salt", F.coalesce(F.pmod(F.col("doc_id"), F.lit(salt)), F.lit(0)))
    out = judged.join(hosts, judged["source"].eqNullSafe(hosts["_s"]) & (judged["_salt"] == hosts["_t"]))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_rate") <= most)).alias("kept"), "host_rate",
    )
