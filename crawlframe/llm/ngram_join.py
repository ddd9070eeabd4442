"""Set similarity self-join on word shingles: T-occurrence search with DivideSkip.

1. Each text becomes the set of its 5-word shingles; texts with equal sets form a class.
2. Classes that can be similar are brought together. Sets with 19 * overlap >= 9 * (a + b) differ in few
   elements, so of m parts, into which elements fall by hash, some part is the same in both. Ranges of set
   sizes fix m; each class gives its parts' hashes for its own range and for the range below, and classes
   with a part in common are connected. Map tasks link equal parts before they send them, so a hot part
   costs a row for each task.
3. Each connected group goes to one task, or where it is larger than `room` shingles, to tasks for pairs of
   its blocks. There an inverted index takes every class as a query: of its lists, the longest are set
   aside, the others are merged (their sorted members are merged stably, or counted where they are more than
   the classes), and classes that reach the threshold less the number of lists set aside are looked up in the
   long lists by binary search.

Edge cases: null and empty texts have no shingles and link with nothing; fewer words than `size` make one
shingle; repeated rows are documents of their own, linked with each other; a null doc_id is never a
component's name unless all its documents have none; very long texts are one set of all their shingles; ties (equal sets) are one
class, named by their least doc_id; an empty table gives an empty result; other columns are ignored, and kept by `keep_first`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, settle
from .graph import bloom, components, in_bloom
from .hashing import U, mix, words

#: Parts beyond those needed, so that a class with this many empty parts still shares one that isn't empty.
SLACK = 3
CHARS = 1_000_000


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = words(texts)
    ends = np.cumsum(counts)
    held = np.zeros(len(hashes) + size, dtype=U)
    held[: len(hashes)] = hashes
    rolled = np.zeros(len(hashes), dtype=U)
    for j in range(size):
        rolled = mix(rolled * U(0x9FB21C651E98DF25) + held[j : j + len(hashes)])
    out = []
    for start, n in zip((ends - counts).tolist(), counts.tolist()):
        if n >= size:
            out.append(np.unique(rolled[start : start + n - size + 1]))
        elif n:
            out.append(np.array([int.from_bytes(hashlib.blake2b(hashes[start : start + n].tobytes(), digest_size=8).digest(), "little")], dtype=U))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def node_of(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def ranges(most: int) -> list[int]:
    """First sizes of the ranges: a set of 9 or more links with larger sets of its own range or the next only."""
    out = [9, 10]
    while out[-1] <= most:
        out.append((out[-1] - 1) * 10 // 9 + 1)
    return [*out, (out[-1] - 1) * 10 // 9 + 1]


_ranges = ranges(1 << 40)


def signatures(shingles: np.ndarray) -> np.ndarray:
    """Hashes of the parts of a set, in its own range and the one below."""
    n = len(shingles)
    if n < 9:
        return np.zeros(0, dtype=U)
    own = int(np.searchsorted(_ranges, n, side="right")) - 1
    spread = mix(shingles ^ U(0x632BE59BD9B4E019))
    out = []
    for k in (own, own - 1):
        if k < 0:
            continue
        parts = (_ranges[k + 1] - 1) // 9 + 1 + SLACK
        part = ((spread >> U(32)) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(parts))
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(spread[order], out=sums[1:])
        ends = np.append(at[1:], n)
        value = mix((sums[ends] - sums[at]) ^ mix(np.arange(parts, dtype=U) + U(k << 20)))
        filled = ends > at
        out.append(value if parts - filled.sum() > SLACK else value[filled])
    return np.concatenate(out)


def _texts(batches, size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        cuts = np.flatnonzero(np.diff(lengths // CHARS)) + 1 if len(lengths) else []
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            if b > a:
                yield keys[a:b], shingle_sets([x or b"" for x in texts[a:b].cast(pa.binary()).to_pylist()], size)


def _unique_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def classes(docs: DataFrame, size: int = 5) -> DataFrame:
    """row (doc_id and a hash of the text), n_shingles, class and node (both null without shingles) of each row."""

    def run(batches):
        for keys, sets in _texts(batches, size):
            names = [class_of(s) if len(s) else None for s in sets]
            nodes = [node_of(x) if x else None for x in names]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(nodes, pa.int64())], ["row", "n_shingles", "class", "node"]
            )

    row = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    return docs.select(row.alias("row"), F.col("text").cast("string")).mapInArrow(run, "row struct<doc_id: long, hash: long>, n_shingles long, class binary, node long").select("row.*", "n_shingles", "class", "node")


def _parts(docs: DataFrame, size: int) -> DataFrame:
    """Rows (sig, node): a node for each distinct part of a map task's classes; and, with sig null, nodes (node, other) linked already."""

    def run(batches):
        seen: set[int] = set()
        for _, sets in _texts(batches, size):
            sigs, nodes = [], []
            for s in sets:
                if len(s) >= 9 and (node := node_of(class_of(s))) not in seen:
                    seen.add(node)
                    sigs.append(got := signatures(s))
                    nodes.append(np.full(len(got), node, dtype=np.int64))
            if len(seen) > 500_000:
                seen.clear()
            if sigs:
                sig, node = np.concatenate(sigs).view(np.int64), np.concatenate(nodes)
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                first = np.concatenate([[True], sig[1:] != sig[:-1]])
                low = node[first][np.cumsum(first) - 1]
                a, b = _unique_rows(low[~first], node[~first])
                yield pa.RecordBatch.from_arrays([pa.array(sig[first]), pa.array(node[first]), pa.nulls(first.sum(), pa.int64())], ["sig", "node", "other"])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["sig", "node", "other"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "sig long, node long, other long")


def _stars(parts: DataFrame) -> DataFrame:
    """Edges (a, b) from the first node of each part to the others; reads sorted rows as they come."""

    def run(batches):
        last, centre = None, None
        for batch in batches:
            sig, node, other = (batch.column(i) for i in range(3))
            linked = pc.is_null(sig).to_numpy(zero_copy_only=False)
            if linked.any():
                a, b = _unique_rows(node.filter(pa.array(linked)).to_numpy(), other.filter(pa.array(linked)).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            sig, node = sig.filter(pa.array(~linked)).to_numpy(), node.filter(pa.array(~linked)).to_numpy()
            if not len(sig):
                continue
            first = np.concatenate([[sig[0] != last], sig[1:] != sig[:-1]])
            centres = np.concatenate([[centre if centre is not None else 0], node[first]]).astype(np.int64)
            mine = centres[np.cumsum(first)]
            last, centre = sig[-1], mine[-1]
            away = mine != node
            if away.any():
                a, b = _unique_rows(mine[away], node[away])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # Links already made have no part; they are spread by their nodes.
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, F.coalesce("sig", F.xxhash64("node", "other"))).sortWithinPartitions("sig", "node").mapInArrow(run, "a long, b long")


def divide_skip(sets: list[np.ndarray], queries: list[np.ndarray] | None = None, weigh: float = 0.02) -> list[tuple[int, int]]:
    """Pairs (query, set) with 19 * overlap >= 9 * (sizes' sum); without queries, pairs q < s of the sets themselves."""
    own = queries is None
    queries = sets if own else queries
    sizes = np.array([len(s) for s in sets])
    if not len(sets):
        return []
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    cells = np.sort(token * len(sets) + member)  # all inverted lists, one after the other
    start = np.searchsorted(cells, np.arange(len(tokens) + 1) * len(sets))
    length = np.diff(start)
    out = []
    for q, query in enumerate(queries):
        n = len(query)
        at = np.searchsorted(tokens, query)
        at = at[tokens[np.minimum(at, len(tokens) - 1)] == query]
        need = -(-9 * n // 10)
        if len(at) < need:
            continue
        by = at[np.argsort(length[at], kind="stable")]
        long = min(need - 1, int(need / (weigh * math.log2(max(2, length[by[-1]])) + 1)))
        # Lists of a group of near copies are all long; setting them aside pays only where they are longer than the rest.
        while long and length[by[-long]] <= 2 * max(1, length[by[0]]):
            long //= 2
        short, far = by[: len(by) - long], by[len(by) - long :]
        span = length[short]
        flat = np.repeat(start[short] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        met = cells[flat] % len(sets)
        if len(met) < len(sets):
            met.sort(kind="stable")  # merges the runs
            first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
            ids, count = met[first], np.diff(np.append(first, len(met)))
        else:
            count = np.bincount(met, minlength=len(sets))
            ids = np.arange(len(sets))
        near = (count >= max(1, need - long)) & (10 * sizes[ids] >= 9 * n) & (9 * sizes[ids] <= 10 * n)
        if own:
            near &= ids > q
        found, overlap = ids[near], count[near]
        if not len(found):
            continue
        if long:
            wanted = far[:, None] * len(sets) + found[None, :]
            place = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            overlap = overlap + (cells[place] == wanted).sum(axis=0)
        out += [(q, int(s)) for s in found[19 * overlap >= 9 * (n + sizes[found])]]
    return out


def _search(rows: DataFrame) -> DataFrame:
    """For each class of rows (task, side, alone, class, copies, low, shingles): copies it links with there, and the class that names its local component."""

    def solve(group: list[dict]) -> list[tuple]:
        by = {(r["side"], r["class"]): r for r in group}
        left, right = ([r for (s, _), r in by.items() if s == side] for side in (0, 1))
        sets = lambda rs: [np.frombuffer(r["shingles"], dtype=U) for r in rs]
        if not group[0]["alone"]:
            pairs = [(len(left) + q, s) for q, s in divide_skip(sets(left), sets(right))]
        else:
            pairs = divide_skip(sets(left))
        every = left + right
        root, linked = list(range(len(every))), [0] * len(every)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in pairs:
            linked[a] += every[b]["copies"]
            linked[b] += every[a]["copies"]
            x, y = find(a), find(b)
            if x != y:
                low, high = sorted((x, y), key=lambda i: (every[i]["low"] is None, every[i]["low"], every[i]["class"]))
                root[high] = low
        return [(r["class"], linked[i], every[find(i)]["class"], every[find(i)]["low"]) for i, r in enumerate(every) if linked[i]]

    def run(batches):
        task, group = None, []

        def flush():
            got = solve(group)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), (pa.binary(), pa.int64(), pa.binary(), pa.int64()))], ["class", "linked", "root", "low"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] != task and group:
                    yield from flush()
                    group = []
                task = r["task"]
                group.append(r)
        if group:
            yield from flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(4 * n, "task").sortWithinPartitions("task").mapInArrow(run, "class binary, linked long, root binary, low long")


def similar(docs: DataFrame, size: int = 5, room: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id of each row of documents."""
    return _similar(docs, size, room).drop("hash")


def _similar(docs: DataFrame, size: int, room: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    held = settle(classes(docs, size), "classes")
    kinds = settle(held.filter("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("node").alias("node")), "kinds")
    groups = components(_stars(_parts(docs, size)))
    near = settle(kinds.join(groups, "node").select("class", "node", "copies", "low", "n", "component"), "near")
    total = near.groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    placed = near.join(total, "component").withColumn("blocks", F.ceil(F.col("total") / F.lit(room)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select(
        "class", "copies", "low", F.expr("blocks > 1").alias("split"),
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("task"), F.expr("cast(block > other AS int)").alias("side"), F.expr("block = other").alias("alone"),
    )
    # One row of each class is read again: a Bloom filter of bounded size picks it out, and a few others.
    low = F.coalesce("low", F.lit(0))
    key = F.col("node").bitwiseXOR(F.shiftleft(low, 20)).bitwiseXOR(low)
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(near.select(key.alias("key"))))

    def run(batches):
        for keys, sets in _texts(batches, size):
            big = [(k or 0, class_of(s), s) for k, s in zip(keys.to_pylist(), sets) if len(s) >= 9]
            if big:
                id_, node = np.array([k for k, *_ in big], dtype=np.int64), np.array([node_of(c) for _, c, _ in big], dtype=np.int64)
                some = np.flatnonzero(in_bloom(filter_.value, node ^ (id_ << 20) ^ id_)).tolist()
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([big[i][1] for i in some], pa.binary()), pa.array([big[i][2].tobytes() for i in some], pa.binary())], ["class", "shingles"])

    sets = docs.mapInArrow(run, "class binary, shingles binary")
    found = settle(_search(placed.hint("merge").join(sets, "class").select("task", "side", "alone", "class", "copies", "low", "shingles")), "found")
    name = found.groupBy("class").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("times"))
    # Groups searched in one task have their component already; those in several are joined by their tasks' stars.
    wide = placed.filter("split").select("class").distinct()
    stars = found.join(wide, "class", "left_semi").select(F.col("class").alias("a"), F.col("root").alias("b"))
    many = stars.limit(1).count()
    if many:
        roots = components(stars).select(F.col("node").alias("class"), "component")
        lows = roots.join(kinds.select("class", "low"), "class").groupBy("component").agg(F.min("low").alias("wide_low"))
        name = name.join(roots.join(lows, "component"), "class", "left").select("class", F.coalesce("wide_low", "low").alias("low"))
    linked = found.groupBy("class").agg(F.sum("linked").alias("linked")).join(name.select("class", F.col("low").alias("least")), "class")
    known = kinds.join(linked, "class", "left").select("class", "copies", "linked", F.coalesce("least", "low").alias("component"))
    out = held.join(known, "class", "left")
    return out.select(
        "doc_id", "hash", "n_shingles", F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def keep_first(docs: DataFrame, size: int = 5, room: int = 2_000_000) -> DataFrame:
    """docs with one document of each component: that with the least doc_id; of its repeated rows, one.

    A null doc_id goes where its component has others. Documents without shingles all stay.
    """
    held: list[str] = []
    for name in ("_id", "_hash", "_at", "_n"):
        held.append(free(name, [*docs.columns, *held]))
    id_, hash_, at, n = held
    found = settle(_similar(docs, size, room), "similar").filter("n_shingles > 0")
    goes = found.filter("NOT (doc_id <=> component_id)").select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_)).distinct()
    keyed = docs.withColumn(at, F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(at) == F.col(hash_))
    kept = keyed.join(goes, on, "left_anti")
    again = found.filter("doc_id <=> component_id").groupBy("doc_id", "hash").count().filter("count > 1")
    if again.limit(1).count():
        # Only a table with repeated rows needs them numbered.
        again = again.select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_))
        single = kept.join(again, on, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy("doc_id", at).orderBy(at))).filter(F.col(n) == 1).drop(n)
        kept = kept.join(again, on, "left_anti").unionByName(single)
    return kept.drop(at)
