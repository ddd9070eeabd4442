"""Replays of the crawl's controllers over logged events, each an ordered fold by key.

Controllers are folded in Python, a key's events streamed in order by sorted partitions, so that no key's log is held in
memory. A fold is a chain: each state needs the one before, so one key's events are read by one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aimd(events: DataFrame, key: str, order: list[str], ok: str = "ok", start: int = 10, least: int = 1, most: int = 200, streak: int = 10, factor: float = 0.5) -> DataFrame:
    """Concurrency after each key's events: one more after every `streak` successes, times `factor` (in single precision, half away from zero) after a setback."""
    cut = [min(max(math.floor(float(np.float32(n) * np.float32(factor)) + 0.5), least), most) for n in range(most + 1)]

    def step(s, good):
        if not good:
            s["n"], s["s"] = cut[s["n"]], 0
        elif s["s"] + 1 >= streak:
            s["n"], s["s"] = min(s["n"] + 1, most), 0
        else:
            s["s"] += 1

    return last(events, key, order, [ok], lambda: {"n": start, "s": 0}, step, lambda s: (s["n"],), "desired int")


def scale(decisions: DataFrame, key: str, order: str, start: int, least: int = 1, most: int = 200, ratio: float = 0.05) -> DataFrame:
    """Concurrency after each key's decisions (up, down, hold): steps of the ratio, rounded up, at least one."""

    def step(s, decision):
        by = max(math.ceil(s["n"] * ratio), 1)
        if decision == "up":
            s["n"] = min(s["n"] + by, most)
        elif decision == "down":
            s["n"] = max(s["n"] - by, least)

    return last(decisions, key, [order], ["decision"], lambda: {"n": start}, step, lambda s: (s["n"],), "desired int")


def _sorted(events: DataFrame, key: str, order: list[str], used: list[str]) -> DataFrame:
    return events.select(*dict.fromkeys([key, *order, *used])).repartition(key).sortWithinPartitions(key, *order)


def last(events: DataFrame, key: str, order: list[str], used: list[str], start: Callable[[], dict], step: Callable, result: Callable[[dict], tuple], columns: str) -> DataFrame:
    """A row for each key: what result(state) gives after all its events; step(state, *used) changes the state in place."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, rows, kind = None, None, [], None
        for batch in batches:
            kind = batch.schema.field(key).type
            for k, *values in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in used)):
                if state is None or k != current:
                    if state is not None:
                        rows.append((current, *result(state)))
                    current, state = k, start()
                step(state, *values)
            if len(rows) > 10_000:
                yield _batch(rows, names, kind)
                rows = []
        if state is not None:
            rows.append((current, *result(state)))
        if rows:
            yield _batch(rows, names, kind)

    return _sorted(events, key, order, used).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int32()) for c in columns[1:])], names)


def fold(events: DataFrame, key: str, order: list[str], used: list[str], start: Callable[[], dict], step: Callable[..., tuple], columns: str) -> DataFrame:
    """A row for each event: key, the order's columns, and what step(state, *order, *used) returns; the state is changed in place."""
    kinds = {"boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    schema = ", ".join([f"{c} {events.schema[c].dataType.simpleString()}" for c in (key, *order)]) + ", " + columns
    names, types = zip(*[c.split() for c in columns.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            rows = []
            for k, *values in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in (*order, *used))):
                if state is None or k != current:
                    current, state = k, start()
                rows.append(step(state, *values))
            if rows:
                found = [pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *order)), *found], [key, *order, *names])

    return _sorted(events, key, order, used).mapInArrow(run, schema)


def token_bucket(events: DataFrame, key: str, at: str, per_minute: int) -> DataFrame:
    """granted and wait (seconds) of each attempt at `at` (seconds): one token at first, `per_minute` at most."""
    rate = per_minute / 60.0

    def step(s, now):
        s["tokens"] = min(s["tokens"] + max(0.0, now - s.get("last", now)) * rate, float(per_minute))
        s["last"] = now
        if s["tokens"] >= 1.0:
            s["tokens"] -= 1.0
            return True, 0.0
        return False, (1.0 - s["tokens"]) / rate

    return fold(events, key, [at], [], lambda: {"tokens": 1.0}, step, "granted boolean, wait double")


def host_limiter(events: DataFrame, key: str, at: str, delay: float = 0.0, floor: float = 0.0, most: float = 300.0) -> DataFrame:
    """Seconds to wait for each reservation (kind reserve); responses (kind response: status, retry_after) change the host's state.

    429 adds a penalty that doubles each time; other statuses clear it; Retry-After moves the next slot on.
    """

    def step(s, now, kind, status, wait):
        if kind == "reserve":
            slot = max(s["next"] if s["next"] is not None else now, now)
            s["next"], s["last"] = slot + max(delay, floor) + s["penalty"], slot
            return (slot - now,)
        if status is not None:
            spaced = None if s["last"] is None else s["last"] + max(delay, floor)
            if status == 429:
                s["count"] += 1
                s["penalty"] = min(max(delay, 1.0) * 2 ** min(s["count"] - 1, 31), most)
                base = spaced if spaced is not None else s["next"] if s["next"] is not None else now
                s["next"] = max(base, now) + s["penalty"]
            else:
                s["count"], s["penalty"], s["next"] = 0, 0.0, spaced
        if wait is not None:
            s["next"] = max(now + wait, s["next"] if s["next"] is not None else now + wait)
        return (None,)

    return fold(events, key, [at], ["kind", "status", "retry_after"], lambda: {"next": None, "last": None, "count": 0, "penalty": 0.0}, step, "wait double")


def proxy_tiers(events: DataFrame, key: str, order: str, sizes: list[int], probe: int = 20) -> DataFrame:
    """tier and member that serve each request; blocked escalates its host, every `probe`-th request tries one tier lower."""

    def step(s, _, blocked):
        s["requests"] += 1
        serving = s["tier"]
        if s["tier"] > 0 and s["requests"] % probe == 0:
            serving = s["probing"] = s["tier"] - 1
        out = serving, s["requests"] % sizes[serving] if sizes[serving] else None
        trying, s["probing"] = s["probing"], None
        if blocked and trying is None:
            s["tier"], s["requests"] = min(s["tier"] + 1, len(sizes) - 1), 0
        elif not blocked and trying is not None:
            s["tier"], s["requests"] = trying, 0
        return out

    return fold(events, key, [order], ["blocked"], lambda: {"tier": 0, "requests": 0, "probing": None}, step, "tier int, member int")


def session_pool(events: DataFrame, key: str, order: str, at: str, size: int = 1000, most_score: int = 3000, most_usage: int = 50, age: float = 3000.0, seed: int = 0) -> DataFrame:
    """session and created for each request (ok; sticky: a session's number or null): sticky, a new one below capacity, or a pick by a hash of seed and order."""

    def step(s, place, now, ok, wanted):
        usable = lambda x: x["score"] < most_score and x["usage"] < most_usage and now < x["expires"]
        pool = s["pool"]
        found = next((x for x in pool if x["id"] == wanted and usable(x)), None) if wanted is not None else None
        created = False
        if found is None:
            pool[:] = [x for x in pool if usable(x)]
            if len(pool) < size or not pool:
                found, created = {"id": s["next"], "score": 0, "usage": 0, "expires": now + age}, True
                s["next"] += 1
                if len(pool) < size:
                    pool.append(found)
            else:
                found = pool[int(hashlib.md5(f"{seed}:{place}".encode()).hexdigest()[:8], 16) % len(pool)]
        found["usage"] += 1
        found["score"] = max(0, found["score"] - 500) if ok else found["score"] + 1000
        return found["id"], created

    return fold(events, key, [order], [at, "ok", "sticky"], lambda: {"pool": [], "next": 0}, step, "session long, created boolean")
