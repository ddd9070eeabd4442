"""Near-duplicate embeddings by NN-descent.

1. Equal vectors of one label are one node. Nodes get first neighbours from a few orders by sign bits of
   random projections, in runs of RUN nodes of one label.
2. Each round joins neighbours: for every node, its nearest neighbours and those it is a neighbour of are
   compared with each other, and every node keeps its K best.
3. Edges at or above the threshold connect groups. A list of K is saturated where all its K are at or above
   the threshold; a link that no list holds is one between two nodes with saturated lists. All such nodes of
   a label are compared with each other, in blocks of bounded size, and links between groups connect these.
4. Every group's nodes are compared in blocks likewise, which counts all links within groups exactly.
5. An audit compares a bounded number of nodes with all others; where its recall is below `enough`, further
   orders are added, and the audit repeated. If TRIES times were not enough, all nodes of a label are compared.

Only vectors of one label and one dimension are compared, by cosine in double precision.

Edge cases: null labels, null, zero or empty vectors and those with null or non-finite components link with
nothing; repeated rows are vectors of their own, linked with each other; a null vec_id is never a component's
name unless all have none; very long vectors are compared whole; of equally near neighbours the one with the least number stays;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .graph import components

K, RUN, ORDERS, ROUNDS, TRIES = 8, 64, 6, 2, 3


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, at[:-1])


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _groups(batches, keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of `most` rows at most, from sorted batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        cuts = np.zeros(max(0, len(table) - 1), dtype=bool)
        for k in keys:
            c = table.column(k).to_numpy()
            cuts |= c[1:] != c[:-1]
        at = [0, *(np.flatnonzero(cuts) + 1).tolist()]
        for a, b in zip(at, at[1:]):
            for i in range(a, b, most or b - a):
                yield table.slice(i, min(b - i, most or b - a))
        held = table.slice(at[-1]) if len(table) else held
        while most and held is not None and len(held) > most:
            yield held.slice(0, most)
            held = held.slice(most)
    if held is not None and len(held):
        yield held


def _edges(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "sim"])


def _best(edges: DataFrame, k: int = K) -> DataFrame:
    pairs = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("_r") <= k).drop("_r")


def first_edges(nodes: DataFrame, seed: int) -> DataFrame:
    """Directed edges (a, b, sim): the K best of each node in its run of each order."""

    def codes(batches):
        for batch in batches:
            vectors = _vectors(batch.column(2))
            for o in range(ORDERS):
                code = np.zeros(len(vectors), dtype=np.int64)
                for d in {len(v) for v in vectors}:
                    mine = np.array([len(v) == d for v in vectors])
                    plane = np.random.default_rng([seed, o, d]).standard_normal((d, 48))
                    x = np.stack([v for v, m in zip(vectors, mine) if m])
                    code[mine] = (x @ plane > 0) @ (1 << np.arange(47, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(vectors), o)), pa.array(code)], ["node", "kind", "embedding", "order", "code"])

    def near(batches):
        for run in _groups(batches, ["order", "kind"], RUN):
            if len(run) < 2:
                continue
            node, x = run.column("node").to_numpy(), _unit(_vectors(run.column("embedding").combine_chunks()))
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            k = min(K, len(node) - 1)
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            yield _edges(np.repeat(node, k), node[top].ravel(), np.take_along_axis(sim, top, axis=1).ravel())

    coded = nodes.mapInArrow(codes, "node long, kind long, embedding array<double>, order long, code long")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A hot label is cut by the first bits of its codes.
    spread = coded.repartition(n, "order", "kind", F.shiftright("code", 44)).sortWithinPartitions("order", "kind", "code")
    return _best(spread.mapInArrow(near, "a long, b long, sim double"))


def refine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One round: neighbours of each node, either way, become candidates of each other."""
    either = _best(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")), 2 * K)
    worst = edges.groupBy("a").agg(F.when(F.count(F.lit(1)) < K, -2.0).otherwise(F.min("sim")).alias("worst"))
    worst = worst.withColumnRenamed("a", "node")
    held = nodes.select("node", "embedding").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    local = either.select(F.col("a").alias("centre"), F.col("b").alias("node")).join(held.hint("merge"), "node").select("centre", "node", "worst", "embedding")

    def join(batches):
        for group in _groups(batches, ["centre"]):
            if len(group) < 2:
                continue
            node, worst_of = group.column("node").to_numpy(), group.column("worst").to_numpy()
            x = _unit(_vectors(group.column("embedding").combine_chunks()))
            sim = x @ x.T
            a, b = np.nonzero((sim > worst_of[:, None]) & (node[:, None] != node[None, :]))
            if len(a):
                yield _edges(node[a], node[b], sim[a, b])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fresh = local.repartition(n, "centre").sortWithinPartitions("centre").mapInArrow(join, "a long, b long, sim double")
    return _best(edges.unionByName(fresh))


def audit(nodes: DataFrame, groups: DataFrame, least: float, queries: int = 400) -> float:
    """Share of the links of `queries` nodes, found by brute force against all nodes, that lie within groups."""
    sample = nodes.orderBy(F.xxhash64("node")).limit(queries).toArrow()
    if not len(sample):
        return 1.0
    held = nodes.sparkSession.sparkContext.broadcast((sample.column("node").to_numpy(), sample.column("kind").to_numpy(), sample.column("embedding").to_pylist()))  # `queries` vectors

    def scan(batches):
        ids, kinds, vectors = held.value
        for batch in batches:
            node, kind, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _vectors(batch.column(2))
            for k in np.unique(kinds):
                q, r = np.flatnonzero(kinds == k), np.flatnonzero(kind == k)
                if len(r):
                    sim = _unit([np.array(vectors[i]) for i in q]) @ _unit([own[i] for i in r]).T
                    i, j = np.nonzero((sim >= least) & (ids[q][:, None] != node[r][None, :]))
                    if len(i):
                        yield _edges(ids[q][i], node[r][j], sim[i, j])

    true = nodes.mapInArrow(scan, "a long, b long, sim double")
    at = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"at_{c}"))
    met = true.join(at("a"), "a", "left").join(at("b"), "b", "left")
    n, found = met.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("at_a") == F.col("at_b")).cast("long")), F.lit(0))).first()
    return found / n if n else 1.0


def saturated(edges: DataFrame, least: float) -> DataFrame:
    """The nodes whose lists are full of links, so that they may have more."""
    lists = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    return lists.filter((F.col("n") >= K) & (F.col("low") >= least)).select(F.col("a").alias("node"))


def bridges(nodes: DataFrame, groups: DataFrame, least: float, room: int = 2048) -> DataFrame:
    """Links (a, b, sim) between groups: all nodes of a kind are compared, and of the links that two groups have in a pair of blocks, one is kept. A node without group is one of its own."""
    held = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("members"))
    placed = held.join(sizes, "kind").withColumn("blocks", F.ceil(F.col("members") / F.lit(room)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    task = F.xxhash64("kind", F.least("block", "other"), F.greatest("block", "other"))
    placed = placed.select(task.alias("task"), F.expr("cast(block > other AS bigint)").alias("side"), F.expr("cast(block = other AS bigint)").alias("alone"), "node", "component", "embedding")

    def compare(batches):
        for group in _groups(batches, ["task"]):
            node, component, side = (group.column(c).to_numpy() for c in ("node", "component", "side"))
            x = _unit(_vectors(group.column("embedding").combine_chunks()))
            left, right = (np.arange(len(node)),) * 2 if group.column("alone")[0].as_py() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            for i in range(0, len(left), 512):
                mine = left[i : i + 512]
                sim = x[mine] @ x[right].T
                a, b = np.nonzero((sim >= least) & (component[mine][:, None] != component[right][None, :]))
                if len(a):
                    one = np.unique(np.column_stack([component[mine[a]], component[right[b]]]), axis=0, return_index=True)[1]
                    yield _edges(node[mine[a[one]]], node[right[b[one]]], sim[a[one], b[one]])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "task").sortWithinPartitions("task").mapInArrow(compare, "a long, b long, sim double")


def connect(compared: DataFrame, links: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """groups, joined where nodes of `compared` have links between them."""
    found = settle(bridges(compared, groups, least), "bridges")
    return components(links.unionByName(found)) if found.limit(1).count() else groups


def count_links(members: DataFrame, least: float, room: int = 2048) -> DataFrame:
    """members: node, component, copies, embedding. For each node, the copies of other nodes of its group at or above `least`."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("members") / F.lit(room)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    task = F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))
    placed = placed.select(task.alias("task"), F.expr("cast(block > other AS bigint)").alias("side"), F.expr("cast(block = other AS bigint)").alias("alone"), "node", "copies", "embedding")

    def count(batches):
        for group in _groups(batches, ["task"]):
            node, copies, side = (group.column(c).to_numpy() for c in ("node", "copies", "side"))
            x = _unit(_vectors(group.column("embedding").combine_chunks()))
            alone = group.column("alone")[0].as_py()
            total = np.zeros(len(node), dtype=np.int64)
            for i in range(0, len(node), 512):
                hit = x[i : i + 512] @ x.T >= least
                hit &= (node[i : i + 512, None] != node[None, :]) if alone else (side[i : i + 512, None] != side[None, :])
                total[i : i + 512] = hit @ copies
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "links"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = placed.repartition(n, "task").sortWithinPartitions("task").mapInArrow(count, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, least: float = 0.98, enough: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label)."""
    wide = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    good = good & F.coalesce(F.exists(wide, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", wide.alias("embedding"), good.alias("good"))
    name = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda v: v.cast("string")), ",")))
    rows = rows.withColumn("name", F.when(F.col("good"), name)).drop("good")
    kinds = rows.filter("name IS NOT NULL").groupBy("name").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"), F.any_value("embedding").alias("embedding"), F.any_value("label").alias("label")
    )
    node = F.conv(F.substring("name", 1, 15), 16, 10).cast("long")  # 60 bits
    kinds = settle(kinds.withColumn("node", node).withColumn("kind", F.xxhash64("label", F.size("embedding"))), "nodes")
    nodes = kinds.select("node", "kind", "embedding")
    edges, groups = None, None
    for attempt in range(TRIES):
        fresh = first_edges(nodes, attempt)
        edges = settle(_best(edges.unionByName(fresh)) if edges is not None else fresh, "edges")
        for _ in range(ROUNDS):
            edges = settle(refine(nodes, edges), "edges")
        links = edges.filter(F.col("sim") >= least)
        groups = connect(nodes.join(saturated(edges, least), "node", "left_semi"), links, components(links), least)
        if audit(nodes, groups, least) >= enough:
            break
    else:
        groups = connect(nodes, links, groups, least)
    members = kinds.join(groups, "node").select("node", "component", "copies", "low", "embedding")
    links = settle(count_links(members, least), "links")
    lows = groups.join(kinds.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least"))
    named = groups.join(lows, "component").select("node", "least")
    known = kinds.select("name", "node", "copies", "low").join(links, "node", "left").join(named, "node", "left")
    known = known.select("name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least", "low").alias("component"))
    out = rows.select("vec_id", "name").join(known, "name", "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
    )
