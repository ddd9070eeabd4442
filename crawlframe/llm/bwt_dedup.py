"""Exact removal of repeated passages: every byte in a string of `window` bytes that also starts elsewhere.

1. Each window of `window` bytes has an anchor: the place in it where the hash of ANCHOR bytes is least, the
   first such. Equal windows have equal anchors at equal offsets. Windows next to each other that share
   an anchor's place form a run, whose bytes are a segment.
2. Runs whose anchor is found once only hold no repeated window. Of the others, equal segments are counted:
   where one occurs twice, all its windows are repeated.
3. Segments that occur once but share an anchor with others may be repeated in part. Segments of one anchor
   go to one task, where they are compared as suffixes: they are dealt to shards, each shard's suffixes are
   sorted and its Burrows-Wheeler transform taken, and the transforms are merged. The transforms' symbols
   stand for SYMBOL bytes each. The merge starts with the shards one after the other and refines their
   interleave, a symbol a round, by a stable distribution of the transforms; boundaries between blocks of
   equal prefixes are derived on the way. Suffixes are not sorted again. After window / SYMBOL rounds,
   blocks are the intervals of equal windows.
4. Anchors with more than `room` bytes of segments (a hot passage in ever other surroundings) are not brought
   into one task: their windows' hashes are counted by a shuffle instead, with the same result.

Windows are compared by 64-bit hashes, in 3 of SYMBOL bytes each.

Edge cases: texts are judged as UTF-8; null and empty texts have no bytes; texts shorter than the window keep
everything; repeated rows are repeats of each other; very long texts are read whole, in overlapping blocks; of places with equal least
hashes the first is the anchor; an empty table gives an empty result; other columns are
ignored, and kept by `remove_repeats`, where characters that were cut in two go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, pieces, settle
from .graph import bloom, in_bloom
from .hashing import U, mix, prefix, spans

WINDOW, ANCHOR, SHARDS, BLOCK, SYMBOL = 400, 48, 4, 1 << 22, 50
CHARS = 1_000_000


def runs(data: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """First and last window start of each run, the anchor's hash, and the hash of the segment with the anchor's place."""
    first, last, marks, keys = [], [], [], []
    for base in range(0, max(0, len(data) - window + 1), BLOCK):
        part = data[base : base + BLOCK + window - 1]
        sums = prefix(part)
        n = len(part) - anchor + 1
        grams = spans(sums, np.arange(n), np.arange(n) + anchor)
        # Hash in the upper bits, place in the lower: the least is the leftmost of the least.
        ranked = (grams & ~U((1 << 23) - 1)) | np.arange(n, dtype=U)
        width = window - anchor + 1
        size = -(-n // width) * width
        padded = np.full(size, ~U(0))
        padded[:n] = ranked
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - window + 1
        at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & U((1 << 23) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        end = np.append(cut[1:], windows) - 1
        mark = grams[at[cut]]
        first.append(cut + base)
        last.append(end + base)
        marks.append(mark)
        keys.append(mix(spans(sums, cut, end + window) ^ mix(mark) ^ (at[cut] - cut).astype(U)))
    if not first:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    return np.concatenate(first), np.concatenate(last), np.concatenate(marks).view(np.int64), np.concatenate(keys).view(np.int64)


def symbols(texts: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The alphabet's numbers for the k bytes at each place of the (circular) texts; the order of the alphabet is arbitrary, but one for all."""
    wide = []
    for t in texts:
        sums = prefix(np.concatenate([t, t[:k]]))
        start = np.arange(len(t))
        wide.append(spans(sums, start, start + k))
    number = np.unique(np.concatenate(wide), return_inverse=True)[1].astype(np.int64)
    return np.split(number, np.cumsum([len(t) for t in texts])[:-1])


def shard_bwt(symbol: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotations of a shard in the order of their symbols, by `depth` bytes at least, and the symbol before each: the shard's transform."""
    rank, known = symbol, k
    while known < depth:
        rank = np.unique(rank * (int(rank.max()) + 1) + np.roll(rank, -known), return_inverse=True)[1].astype(np.int64)
        known *= 2
    order = np.argsort(rank, kind="stable")
    return order, np.roll(symbol, k)[order].astype(np.int32)


def _stable_order(symbol: np.ndarray) -> np.ndarray:
    """Stable order by symbol, distributed by 16 bits at a time."""
    order = np.argsort((symbol & 65535).astype(np.uint16), kind="stable")
    if symbol.max() > 65535:
        order = order[np.argsort((symbol[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge_bwt(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' rotations by their first `rounds` symbols: the shard of each, and the number of its block of equal prefixes."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block = np.zeros(len(shard), dtype=np.int32)
    symbol = np.empty(len(shard), dtype=np.int32)
    for _ in range(rounds):
        for k, t in enumerate(transforms):
            symbol[shard == k] = t
        order = _stable_order(symbol)
        shard, sorted_block, sorted_symbol = shard[order], block[order], symbol[order]
        new = np.ones(len(shard), dtype=bool)
        new[1:] = (sorted_symbol[1:] != sorted_symbol[:-1]) | (sorted_block[1:] != sorted_block[:-1])
        block = np.cumsum(new, dtype=np.int32) - 1
    return shard, block


def repeated_starts(segments: list[np.ndarray], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, whether the window at each of its starts is also at another start of the segments."""
    deal = [list(range(k, len(segments), SHARDS)) for k in range(SHARDS)]
    texts = [np.concatenate([segments[i] for i in d]) for d in deal if d]
    # Rotations run past a segment's end; only those with a whole window before it count.
    valid = [np.concatenate([np.arange(len(segments[i])) <= len(segments[i]) - window for i in d]) for d in deal if d]
    k = max(d for d in range(1, SYMBOL + 1) if window % d == 0)
    sorted_shards = [shard_bwt(x, k, window) for x in symbols(texts, k)]
    shard, block = merge_bwt([b for _, b in sorted_shards], window // k)
    counts = np.zeros(int(block[-1]) + 1, dtype=np.int64)
    marks = []
    for k, (order, _) in enumerate(sorted_shards):
        mine, good = block[shard == k], valid[k][order]
        counts += np.bincount(mine[good], minlength=len(counts))
        held = np.zeros(len(order), dtype=np.int64)
        held[order] = mine
        marks.append(held)
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(segments)
    for d, held in zip([d for d in deal if d], marks):
        at = 0
        for i in d:
            starts = held[at : at + max(0, len(segments[i]) - window + 1)]
            out[i], at = counts[starts] > 1, at + len(segments[i])
    return out


def _ranges(flags: np.ndarray) -> np.ndarray:
    """First and last of each run of true flags, as rows."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def _keys(docs: DataFrame, one: str = "k1", two: str = "k2") -> list:
    """128 bits: Spark's hash goes on from what came before, so the second starts with another number."""
    return [F.xxhash64("text").alias(one), F.xxhash64(F.lit(7), F.col("text")).alias(two)]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows of one text have one key: what is removed depends on the text and all texts only."""
    return docs.select(*_keys(docs), F.col("text").cast("string").alias("text"))


def _rows(docs: DataFrame, window: int) -> DataFrame:
    """k1, k2, first, last, anchor, key of every run."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            held: list[list] = [[], [], [], [], [], []]
            for i, t in enumerate(texts):
                got = runs(np.frombuffer(t.as_py() or b"", dtype=np.uint8), window)
                if len(got[0]):
                    for column, x in zip(held, (np.full(len(got[0]), batch.column(0)[i].as_py()), np.full(len(got[0]), batch.column(1)[i].as_py()), *got)):
                        column.append(x)
            if held[0]:
                a = [np.concatenate(c) for c in held]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(k.to_pandas_dtype())) for x, k in zip(a, kinds)], ["k1", "k2", "first", "last", "anchor", "key"])

    return _keyed(docs).mapInArrow(run, "k1 long, k2 long, first int, last int, anchor long, key long")


def _partial(rows: DataFrame, window: int, batch_bytes: int) -> DataFrame:
    """rows: anchor, key, n, segment. Ranges (key, first, last) of repeated window starts of segments with n = 1, by merged transforms."""

    def solve(group: list[tuple]):
        found = repeated_starts([np.frombuffer(s, dtype=np.uint8) for _, _, s in group], window)
        keys, ranges = [], []
        for (key, n, _), flags in zip(group, found):
            if n == 1 and flags.any():
                r = _ranges(flags)
                keys.append(np.full(len(r), key))
                ranges.append(r)
        if keys:
            r = np.concatenate(ranges)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(r[:, 0].astype(np.int32)), pa.array(r[:, 1].astype(np.int32))], ["key", "lo", "hi"])

    def run(batches):
        group, size, last = [], 0, None
        for batch in batches:
            for anchor, key, n, segment in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if anchor != last and size > batch_bytes:
                    yield from solve(group)
                    group, size = [], 0
                group.append((key, n, segment))
                size, last = size + len(segment), anchor
        if group:
            yield from solve(group)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("anchor", "key", "n", "segment").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "key long, lo int, hi int")


def _hot(rows: DataFrame, window: int) -> DataFrame:
    """As _partial, for anchors with many segments: windows are counted by hash."""

    def run(batches):
        for batch in batches:
            for key, n, segment in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                sums = prefix(np.frombuffer(segment, dtype=np.uint8))
                start = np.arange(len(segment) - window + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spans(sums, start, start + window).view(np.int64)), pa.array(np.full(len(start), key)), pa.array(np.full(len(start), n)), pa.array(start.astype(np.int32))], ["hash", "key", "n", "at"]
                )

    each = rows.select("anchor", "key", "n", "segment").mapInArrow(run, "hash long, key long, n long, at int")
    twice = each.groupBy("hash").count().filter("count > 1").select("hash")
    hit = each.filter("n = 1").join(twice, "hash").select("key", "at")
    # Each start is a range of its own; they are joined where spans of a text are.
    return hit.select("key", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeats(docs: DataFrame, window: int = WINDOW, room: int = 2 << 20, batch_bytes: int = 1 << 20) -> DataFrame:
    """k1, k2 and spans (array of start, end) of the repeated windows of each text that has some; spans may overlap."""
    every = settle(_rows(docs, window), "runs")
    shared = every.groupBy("anchor").count().filter("count > 1").select("anchor")
    held = settle(every.join(shared, "anchor", "left_semi"), "shared")
    segments = settle(held.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first", "last")).alias("where")), "segments")
    length = F.col("where.last") - F.col("where.first") + window
    mixed = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.sum(length.cast("long")).alias("bytes")).filter("kinds > 1 AND least = 1")
    wanted = segments.join(mixed.select("anchor", "bytes"), "anchor").select("anchor", "key", "n", "bytes", "where.*")
    wanted = settle(wanted, "wanted")
    # Of the texts, only those with wanted segments are moved: a Bloom filter of bounded size picks them, and a few more.
    held_bloom = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.col("k1").alias("key"))))

    def pick(batches):
        seen: set[int] = set()
        for batch in batches:
            keep = in_bloom(held_bloom.value, batch.column(0).to_numpy())
            for i in np.flatnonzero(keep):
                k = batch.column(0)[int(i)].as_py()
                keep[i] = k not in seen  # copies in one task are sent once
                seen.add(k)
            if len(seen) > 500_000:
                seen.clear()
            yield batch.filter(pa.array(keep))

    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "key", "n", "bytes", "first", "last")).alias("runs"))
    texts = _keyed(docs).mapInArrow(pick, "k1 long, k2 long, text string")

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            seen = set()
            for k1, k2, text, runs_ in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                data = text.encode()
                for r in runs_:
                    for column, x in zip(out, (r["anchor"], r["key"], r["n"], r["bytes"], data[r["first"] : r["last"] + window])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "key", "n", "bytes", "segment"])

    cuts = texts.join(by_text.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(cut, "anchor long, key long, n long, bytes long, segment binary")
    cuts = settle(cuts.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("anchor", "n", "bytes", "segment")]), "cuts")
    some = _partial(cuts.filter(F.col("bytes") <= room), window, batch_bytes).unionByName(_hot(cuts.filter(F.col("bytes") > room), window))
    some = some.select("key", F.struct("lo", "hi").alias("part"))
    whole = segments.filter("n > 1").select("key", F.expr("named_struct('lo', 0, 'hi', cast(null AS int))").alias("part"))
    verdict = settle(whole.unionByName(some), "verdict")
    # Copies of a text are one row here, however many there are.
    places = held.groupBy("k1", "k2", "first", "last", "key").agg(F.lit(1).alias("_one")).drop("_one")
    spans_ = places.join(verdict, "key").select("k1", "k2", (F.col("first") + F.col("part.lo")).alias("start"), (F.coalesce(F.col("first") + F.col("part.hi"), "last") + window).alias("end"))
    return spans_.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _joined(docs: DataFrame, spans_: DataFrame, columns: list, names: tuple[str, ...]) -> DataFrame:
    """docs' columns, and the starts and ends (null without) of the text's spans. names: free ones for two keys, starts and ends."""
    one, two, starts, ends = names
    rows = docs.select(*columns, *_keys(docs, one, two))
    found = spans_.select(F.col("k1").alias(one), F.col("k2").alias(two), F.transform("spans", lambda s: s["start"]).alias(starts), F.transform("spans", lambda s: s["end"]).alias(ends))
    return rows.join(found.hint("merge"), [one, two], "left").drop(one, two)


def kept(data: bytes, starts, ends) -> tuple[bytes, int]:
    """What is left of data without the spans, and the number of maximal removed runs."""
    if starts is None or not len(starts):
        return data, 0
    delta = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(delta, np.asarray(starts), 1)
    np.add.at(delta, np.asarray(ends), -1)
    gone = np.cumsum(delta[:-1]) > 0
    return np.frombuffer(data, dtype=np.uint8)[~gone].tobytes(), len(_ranges(gone))


def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array):
    """For each text its bytes, what is left of them and the number of removed runs."""
    for i, data in enumerate(texts.cast(pa.binary()).to_pylist()):
        some = starts[i].is_valid
        yield data or b"", *kept(data or b"", starts[i].values.to_numpy() if some else None, ends[i].values.to_numpy() if some else None)


def digest(docs: DataFrame, window: int = WINDOW, room: int = 2 << 20, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_chars (whole characters left) of each row of documents."""
    names = ("_k1", "_k2", "_starts", "_ends")
    found = _joined(docs, settle(repeats(docs, window, room, batch_bytes), "spans"), ["doc_id", F.col("text").cast("string").alias("text")], names)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for data, left, n in _cut(*batch.columns[1:]):
                for column, x in zip(out, (len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), len(left.decode(errors="ignore")))):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "_starts", "_ends").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_chars long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, room: int = 2 << 20, batch_bytes: int = 1 << 20) -> DataFrame:
    """docs with repeated passages taken out of text; n_chars, where there is one, is the new text's length."""
    names = tuple(free(n, docs.columns) for n in ("_k1", "_k2", "_starts", "_ends"))
    found = _joined(docs, settle(repeats(docs, window, room, batch_bytes), "spans"), docs.columns, names)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column(at), CHARS):
                part = batch.slice(a, b - a)
                columns, hit = part.columns[:-2], part.column(len(part.columns) - 2).is_valid().to_numpy(zero_copy_only=False)
                if hit.any():
                    which = np.flatnonzero(hit)
                    some = part.take(pa.array(which))
                    left = [x.decode(errors="ignore") for _, x, _ in _cut(some.column(at), some.column(len(columns)), some.column(len(columns) + 1))]
                    texts = columns[at].to_pylist()
                    for i, x in zip(which.tolist(), left):
                        texts[i] = x
                    columns[at] = pa.array(texts, columns[at].type)
                    if count is not None:
                        sizes = columns[count].to_pylist()
                        for i, x in zip(which.tolist(), left):
                            sizes[i] = len(x)
                        columns[count] = pa.array(sizes, columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-2])

    return found.mapInArrow(run, docs.schema)
