"""Live forms: running statistics, rate windows, leases with timers and result sinks, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """events with `at` as a timestamp, which watermarks need."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def running_statistics(events: DataFrame) -> DataFrame:
    """Finished and failed events and their durations, for outputMode complete or update. events: outcome, duration."""
    return events.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))


def windowed_rates(events: DataFrame, at: str = "ts", window: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Events by outcome in sliding windows; windows close, and leave the state, when the watermark passes them."""
    return timed(events, at).withWatermark(at, late).groupBy(F.window(at, window, slide), "outcome").agg(F.count(F.lit(1)).alias("n"))


def distinct_requests(requests: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first request of each key, as far back as the watermark."""
    return timed(requests, at).withWatermark(at, late).dropDuplicatesWithinWatermark(["unique_key"])


def leases(events: DataFrame, seconds: int = 180, late: str = "10 minutes") -> DataFrame:
    """Follows each request's lease over events (unique_key, kind: lease, renew or done, ts): done, or expired when its time is over.

    The state is one time for each open lease; timers run on event time.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (ends,) = state.get
            state.remove()
            yield pd.DataFrame({"unique_key": [key[0]], "status": ["expired"], "at": [pd.Timestamp(ends, unit="ms")]})
            return
        ends = state.get[0] if state.exists else None
        rows = []
        for batch in batches:
            for e in batch.sort_values("ts").itertuples():
                now = int(e.ts.timestamp() * 1000)
                if e.kind == "done":
                    if ends is not None:
                        rows.append((key[0], "done", e.ts))
                    ends = None
                else:
                    ends = now + seconds * 1000
        if ends is None:
            if state.exists:
                state.remove()
        else:
            state.update((ends,))
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["unique_key", "status", "at"])

    keyed = timed(events).withWatermark("ts", late).groupBy("unique_key")
    return keyed.applyInPandasWithState(follow, "unique_key string, status string, at timestamp", "ends long", "append", GroupStateTimeout.EventTimeTimeout)


def persist_every(events: DataFrame, state, change: Callable[[tuple, DataFrame], tuple], checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """Changes a state by each batch of events and persists it, a version a tick."""

    def tick(batch: DataFrame, _: int) -> None:
        state.set(change(state.get(), batch))
        state.persist()

    return deliver(events, tick, checkpoint, every)


def deliver(results: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """Give each batch of results to a handler; the checkpoint folder must be shared by the cluster."""
    return results.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def replay(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source has now and return the result as a table in memory; for small results and tests."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
