"""The request queue as relations: deduplication, orders, leases, limits and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_S = 180


def add(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests with already_present and already_handled. known: unique_key, handled. The first of equal keys by order_no is new."""
    seen = known.groupBy("unique_key").agg(F.max(F.col("handled").cast("int")).alias("_h"))
    met = requests.join(seen, "unique_key", "left")
    first = F.row_number().over(Window.partitionBy("unique_key").orderBy("order_no"))
    return met.withColumn("already_present", F.col("_h").isNotNull() | (first > 1)).withColumn("already_handled", F.coalesce(F.col("_h") == 1, F.lit(False))).drop("_h")


def unseen(requests: DataFrame, known: DataFrame, key: str = "unique_key") -> DataFrame:
    """Requests whose key isn't known."""
    return requests.join(known.select(key).distinct(), key, "left_anti")


def handled(requests: DataFrame, known: DataFrame, key: str = "unique_key") -> DataFrame:
    return requests.join(known.select(key).distinct(), key, "left_semi")


def order_key(forefront: Column, seq: Column) -> Column:
    """Numbers by which a queue is read: forefront requests first, the latest of them first of all."""
    return F.when(forefront, -seq).otherwise(seq)


def pop(queue: DataFrame, n: int, order: str = "order_no") -> DataFrame:
    """The first n requests of a queue."""
    return queue.orderBy(order).limit(n)


def round_robin(queue: DataFrame, host: str = "host", seq: str = "order_no") -> DataFrame:
    """queue with turn and place: the k-th request of each host comes before any k+1-th; hosts by their first request."""
    w = Window.partitionBy(host)
    return queue.withColumn("turn", F.row_number().over(w.orderBy(seq))).withColumn("place", F.min(seq).over(w))


def lease(queue: DataFrame, n: int, now: Column, order: str = "order_no") -> DataFrame:
    """The first n free requests, leased from now on. queue: lease_expires_at, null or past where a request is free."""
    free = queue.filter(F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
    return pop(free, n, order).withColumn("lease_expires_at", now + F.expr(f"INTERVAL {LEASE_S} SECONDS"))


def renew(leased: DataFrame, now: Column, margin_s: int = 30) -> DataFrame:
    """leased with leases that end within the margin extended."""
    due = F.col("lease_expires_at") <= now + F.expr(f"INTERVAL {margin_s} SECONDS")
    return leased.withColumn("lease_expires_at", F.when(due, now + F.expr(f"INTERVAL {LEASE_S} SECONDS")).otherwise(F.col("lease_expires_at")))


def give_back(leased: DataFrame, abandoned: Column, rotating: Column, seq: Column) -> DataFrame:
    """Leases that end without result: abandoned ones go to the head as they were, others to the tail with one more retry or rotation."""
    return leased.withColumns({
        "order_no": F.when(abandoned, -seq).otherwise(seq),
        "retry_count": F.col("retry_count") + F.when(abandoned | rotating, 0).otherwise(1),
        "session_rotation_count": F.col("session_rotation_count") + F.when(~abandoned & rotating, 1).otherwise(0),
        "lease_expires_at": F.lit(None).cast("timestamp"),
    })


def abort(queue: DataFrame, seq: Column) -> DataFrame:
    """queue (status) with every lease abandoned: leased requests are pending again, at the head and as they were."""
    held = F.col("status") == "leased"
    return queue.withColumn("order_no", F.when(held, -seq).otherwise(F.col("order_no"))).withColumn("status", F.when(held, "pending").otherwise(F.col("status")))


def with_overrides(attempts: DataFrame, overrides: DataFrame, columns: list[str], key: str = "unique_key") -> DataFrame:
    """attempts with what an earlier attempt of the same request left for the next (a user agent, a proxy), where it left something."""
    kept = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return attempts.join(kept, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def finish(leases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs of attempts with their leases' counters; outputs without lease have found = false."""
    kept = leases.select("lease_id", "unique_key", "retry_count", "session_rotation_count", F.lit(True).alias("_f"))
    own = outputs.drop("unique_key", "retry_count", "session_rotation_count")
    return own.join(kept, "lease_id", "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def status_counts(queue: DataFrame) -> DataFrame:
    """pending, leased and handled requests, and whether the queue is empty and finished."""
    n = lambda s: F.count_if(F.col("status") == s)
    return queue.agg(n("pending").alias("pending"), n("leased").alias("leased"), n("handled").alias("handled")).selectExpr("*", "pending = 0 AS is_empty", "pending = 0 AND leased = 0 AS is_finished")


def ready_order(deferred: DataFrame) -> DataFrame:
    """Deferred starts with the order in which they become ready, row by row."""
    return deferred.orderBy("ready_at", "seq")


def attempt_numbers(attempts: DataFrame, key: str, at: list[str]) -> DataFrame:
    """attempts with attempt: 0 for a key's first, and so on."""
    return attempts.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy(*at)) - 1)


def with_tandem(queue: DataFrame, sitemap: DataFrame) -> DataFrame:
    """A queue followed by a sitemap's requests, each key once, its first occurrence."""
    both = queue.withColumn("_s", F.lit(0)).unionByName(sitemap.withColumn("_s", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("unique_key").orderBy("_s", "order_no"))).filter("_n = 1").drop("_n", "_s")
