"""Request identity: FNV-1a hashes, unique keys and request ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import without_fragment

OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(values: list[bytes], seeds: np.ndarray | None = None) -> np.ndarray:
    """FNV-1a of each value, all values a byte at a time."""
    out = np.full(len(values), OFFSET, dtype=np.uint64) if seeds is None else seeds.copy()
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    data, start = np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum(lengths) - lengths
    start, live, lengths = start[order], out[order], lengths[order]
    for i in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -i, side="left"))  # those longer than i
        live[:n] = (live[:n] ^ data[start[:n] + i]) * np.uint64(PRIME)
    out[order] = live
    return out


def _bytes(values: pd.Series) -> list[bytes]:
    return [b"" if v is None else v if isinstance(v, bytes) else bytes(v) if isinstance(v, bytearray) else v.encode() for v in values]


@F.pandas_udf(T.StringType())
def fnv1a64_hex(values: pd.Series) -> pd.Series:
    """FNV-1a 64 of UTF-8 text, as 16 hex digits; null counts as empty."""
    return pd.Series([f"{h:016x}" for h in fnv1a(_bytes(values)).tolist()])


@F.pandas_udf(T.StringType())
def request_id(keys: pd.Series) -> pd.Series:
    """32 hex digits: the key's hash, then its hash seeded with the first."""
    data = _bytes(keys)
    first = fnv1a(data)
    return pd.Series([f"{a:016x}{b:016x}" for a, b in zip(first.tolist(), fnv1a(data, first).tolist())])


@F.pandas_udf(T.StringType())
def splitmix64(seeds: pd.Series) -> pd.Series:
    """The first number that the splitmix64 generator gives for a seed, as 16 hex digits: seeds are explicit, so that runs agree."""
    x = seeds.to_numpy(dtype=np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pd.Series([f"{v:016x}" for v in (x ^ (x >> np.uint64(31))).tolist()])


def canonical_form(form: Column) -> Column:
    """Body of a form, an array of (key, value): pairs in their order, not escaped."""
    return F.array_join(F.transform(form, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def unique_key(url: Column, method: Column | None = None, body: Column | None = None) -> Column:
    """The url without fragment for a GET without body; else method, body hash and that url."""
    plain, method, body = without_fragment(url), F.lit("GET") if method is None else method, F.lit(None).cast("string") if body is None else body
    return F.when((method == "GET") & body.isNull(), plain).otherwise(F.concat(method, F.lit("("), fnv1a64_hex(F.coalesce(body, F.lit(""))), F.lit("):"), plain))


def get_key(url: Column) -> Column:
    """unique_key of GET requests without body, without a Python stage in the plan."""
    return without_fragment(url)
