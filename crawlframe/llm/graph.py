"""Connected components and a Bloom filter of bounded size, both without collecting rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node of edges (a, b).

    Each round every node takes the least label among its neighbours' and then its label's label; each
    round's labels are written to the shared folder. Labels only fall, so the rounds end, after about the logarithm of the longest path. Loops and repeated edges do no harm; edges with a
    null end are dropped.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        met = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        best = labels.join(met, labels["node"] == met["a"]).select("node", "label", F.least("label", "low").alias("next"))
        over = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = best.join(over, best["next"] == over["_n"]).select("node", F.least("next", "_l").alias("label"), (F.least("next", "_l") != F.col("label")).alias("moved"))
        jumped = settle(jumped, "labels")
        labels = jumped.drop("moved")
        if not jumped.filter("moved").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))


def bloom(keys: DataFrame, least: int = 1 << 20, most: int = 1 << 28) -> np.ndarray:
    """A Bloom filter (two probes) of the 64-bit column `key`, with 16 bits a key, but never more than `most` bits (32 MB): beyond that it lets more through."""
    bits = min(most, max(least, 1 << (16 * keys.count()).bit_length()))
    at = keys.select(F.explode(F.array(*[F.pmod(F.shiftright("key", s), F.lit(bits)) for s in (0, 29)])).alias("at"))
    held = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("set"))
    out = np.zeros(bits // 64, dtype=np.int64)
    found = held.toArrow()
    out[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return out


def in_bloom(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of the signed 64-bit keys may be in the filter; false only if it isn't."""
    out = np.ones(len(keys), dtype=bool)
    for s in (0, 29):
        at = (keys >> s) % (len(held) * 64)
        out &= (held[at >> 6] >> (at & 63)) & 1 == 1
    return out
