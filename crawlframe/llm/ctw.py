"""Language-model scoring by context-tree weighting, beside a unigram base.

Texts, A-Z lower-cased, are read as bytes, with one zero byte as their end. Each byte is eight binary
decisions; each decision has a tree of contexts, the 0 to DEPTH bytes before it. Every node holds the counts
of zeros and ones in the training texts and the Krichevsky-Trofimov probability of those; a node's weighted
probability is the mean of its own and the product of its children's. A new bit's probability mixes the
estimates of all depths, each node weighing its own by the share it has in its weighted probability.

1. Map tasks count tokens and (context, byte) strings, of all texts, with the training texts' counts.
2. Strings are gathered by their two nearest context bytes, so trees are computed locally down to depth 2;
   what the two depths above need is a table of at most 256 * 255 rows.
3. Scoring looks up the values of frequent tokens and strings in tables of at most `room` rows; the others
   go to a shuffled join. The threshold between them follows the counts; nothing is left out.

Edge cases: null and empty texts have the end only; a null doc_id counts as the empty text in the choice of
training texts; repeated rows are trained on and scored each; very long texts are read whole, in one piece; without training texts N and V are 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, settle
from .hashing import lower, words

DEPTH = 5
CHARS = 1_000_000
END = np.int64(-6148914691236517205)
#: Kinds of keys: tokens and strings.
TOKEN, STRING = 0, 1


def strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts and their ends: it and the `depth` bytes before it, and the text's number."""
    pad = b"\0" * depth
    data = lower(np.frombuffer(b"".join([pad + t + b"\0" for t in texts]), dtype=np.uint8)).astype(np.int64)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    start = np.cumsum(lengths + depth) - lengths
    doc = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(lengths.sum()) + np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
    out = np.zeros(len(at), dtype=np.int64)
    for k in range(depth, -1, -1):
        out = (out << 8) | data[at - k]
    return out, doc


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, and the text's number for each."""
    hashes, counts = words(texts)
    return hashes.view(np.int64), np.repeat(np.arange(len(texts)), counts)


def _chunks(batch, column: int):
    for a, b in pieces(batch.column(column), CHARS):
        yield a, b, [x or b"" for x in batch.column(column)[a:b].cast(pa.binary()).to_pylist()]


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n (times in training texts, 0 for keys of other texts only) of docs (train, text)."""

    def run(batches):
        held: dict[int, list] = {TOKEN: [], STRING: []}

        def flush():
            for kind, parts in held.items():
                if parts:
                    keys, n = _merge(parts)
                    for i in range(0, len(keys), 100_000):
                        part = slice(i, i + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, dtype=np.int32)), pa.array(keys[part]), pa.array(n[part])], ["kind", "key", "n"])
                parts.clear()

        size = 0
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, texts in _chunks(batch, 1):
                own = train[a:b]
                for kind, (key, doc) in ((TOKEN, tokens(texts)), (STRING, strings(texts, depth))):
                    if kind == TOKEN:
                        key = key[own[doc]]
                        key = np.append(key, np.full(own.sum(), END))
                        doc = None
                    keys, at = np.unique(key, return_inverse=True)
                    n = np.bincount(at, weights=None if doc is None else own[doc].astype(float), minlength=len(keys))
                    held[kind].append((keys, n))
                    size += len(keys)
                if size > 2_000_000:
                    for parts in held.values():
                        parts[:] = [_merge(parts)]
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > 1_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    return docs.select("train", "text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log(gamma(x)) for x >= 0.5."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 9
        shift[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - math.log(math.pi) - _lgamma(zeros + ones + 1.0)


def mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of a node's weighted probability, and the weight of its own estimate."""
    weighted = np.logaddexp(own, below) + math.log(0.5)
    return weighted, np.exp(own + math.log(0.5) - weighted)


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each string's last byte the eight decisions: node of the byte's tree, and the bit."""
    byte = key[:, None] & 255
    j = np.arange(8)
    return ((1 << j) | (byte >> (8 - j))).astype(np.int64), (byte >> (7 - j)) & 1


def trees(key: np.ndarray, n: np.ndarray, depth: int):
    """Down to depth 2: for each depth, the node of each decision of each string, and the nodes' counts, weights and weighted probabilities."""
    node, bit = _bits(key)
    context, times, out, below = key >> 8, np.repeat(n, 8), {}, None
    for d in range(depth, 1, -1):
        # The context's nearest d bytes are its lowest ones.
        name = ((context & ((1 << (8 * d)) - 1))[:, None] << 8 | node).ravel()
        names, at = np.unique(name, return_inverse=True)
        one = np.bincount(at, weights=times * bit.ravel(), minlength=len(names))
        zero = np.bincount(at, weights=times * (1 - bit.ravel()), minlength=len(names))
        own = kt(zero, one)
        if below is None:
            weighted, share = own, np.ones(len(names))
        else:
            held, deeper = below  # deeper names' nodes here: drop the farthest byte
            up = np.searchsorted(names, (held >> 8 & ((1 << (8 * d)) - 1)) << 8 | held & 255)
            weighted, share = mixed(own, np.bincount(up, weights=deeper, minlength=len(names)))
        below = (names, weighted)
        out[d] = (at.reshape(-1, 8), zero, one, share, names, weighted)
    return node, bit, out


def _runs(batches, most: int):
    """Sorted batches (stem, key, n), cut between stems, in runs of at least `most` rows."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if len(held) < most:
            continue
        stem = held.column("stem").to_numpy()
        cut = np.flatnonzero(stem[1:] != stem[:-1])
        if len(cut):
            yield held.slice(0, int(cut[-1]) + 1)
            held = held.slice(int(cut[-1]) + 1).combine_chunks()
    if held is not None and len(held):
        yield held


def string_values(counted: DataFrame, depth: int = DEPTH, most: int = 50_000) -> DataFrame:
    """key, n and value (natural log of the byte's probability after its context) of each counted string."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = counted.select(F.expr("shiftright(key, 8) & 65535").alias("stem"), "key", "n").repartition(parts, "stem").sortWithinPartitions("stem")

    def up(batches):
        for run in _runs(batches, most):
            _, _, out = trees(run.column("key").to_numpy(), run.column("n").to_numpy(), depth)
            _, zero, one, _, names, weighted = out[2]
            near = (names >> 8 & 255) << 8 | names & 255
            every, at = np.unique(near, return_inverse=True)
            total = lambda x: pa.array(np.bincount(at, weights=x, minlength=len(every)))
            yield pa.RecordBatch.from_arrays([pa.array(every), total(zero), total(one), total(weighted)], ["name", "zero", "one", "below"])

    top = spread.mapInArrow(up, "name long, zero double, one double, below double").groupBy("name").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "below")]).toArrow()
    # At most 256 * 255 rows: the contexts of one byte.
    name, (zero, one, below) = top.column("name").to_numpy(), (top.column(c).to_numpy() for c in ("zero", "one", "below"))
    first = np.zeros((3, 65536))
    weighted, share = mixed(kt(zero, one), below)
    first[:, name] = share, zero, one
    root = np.zeros((3, 256))
    gather = lambda x: np.bincount(name & 255, weights=x, minlength=256)
    zero, one = gather(zero), gather(one)
    root[:] = mixed(kt(zero, one), gather(weighted))[1], zero, one
    held = counted.sparkSession.sparkContext.broadcast((first, root))

    def down(batches):
        first, root = held.value
        for run in _runs(batches, most):
            key, n = run.column("key").to_numpy(), run.column("n").to_numpy()
            node, bit, out = trees(key, n, depth)
            p = None
            estimate = lambda zero, one: np.where(bit == 1, one + 0.5, zero + 0.5) / (zero + one + 1.0)
            for d in range(depth, 1, -1):
                at, zero, one, share, *_ = out[d]
                own = estimate(zero[at], one[at])
                p = own if p is None else share[at] * own + (1 - share[at]) * p
            for table, at in ((first, (key >> 8 & 255)[:, None] << 8 | node), (root, node)):
                share, zero, one = (row[at] for row in table)
                p = share * estimate(zero, one) + (1 - share) * p
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.log(p).sum(axis=1))], ["key", "n", "value"])

    return spread.mapInArrow(down, "key long, n long, value double")


def split(values: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """values (kind, key, n, ...) in a part of at most `room` rows with the most frequent keys, and the others."""
    by = values.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()  # 64 rows at most
    total, least = 0, 65
    for bits, n in sorted(by, reverse=True):
        if total + n > room:
            break
        total, least = total + n, bits
    often = F.length(F.bin("n")) >= least
    return values.filter(often), values.filter(~often)


def score(docs: DataFrame, depth: int = DEPTH, room: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (the code length of a byte, the end included) of each row of documents."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), (F.crc32(name) % 7 != 2).alias("train"), F.col("text").cast("string"))
    counted = settle(counts(docs, depth), "counts")
    spoken = counted.filter(F.col("kind") == TOKEN)
    n_all, distinct = spoken.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = (spoken.filter(F.col("key") == int(END)).select("n").first() or [0])[0]
    values = settle(
        spoken.filter(F.col("key") != int(END)).select("kind", "key", "n", F.log10(F.col("n") + 1.0).alias("value"))
        .unionByName(string_values(counted.filter(F.col("kind") == STRING), depth).select(F.lit(STRING).alias("kind"), "key", "n", "value")), "values",
    )
    often, seldom = split(values, room)
    got = often.select("kind", "key", "value").toArrow().sort_by([("kind", "ascending"), ("key", "ascending")])
    kind = got.column("kind").to_numpy()
    tables = {k: (got.column("key").to_numpy()[kind == k], got.column("value").to_numpy()[kind == k]) for k in (TOKEN, STRING)}
    held = docs.sparkSession.sparkContext.broadcast(tables)  # at most `room` rows

    def run(batches):
        for batch in batches:
            for a, b, texts in _chunks(batch, 2):
                ids, hashes = batch.column(0)[a:b], batch.column(1)[a:b]
                sums, known, amount, late = {}, {}, {}, []
                for kind, (key, doc) in ((TOKEN, tokens(texts)), (STRING, strings(texts, depth))):
                    names, value = held.value[kind]
                    keys, at = np.unique(key, return_inverse=True)
                    place = np.minimum(np.searchsorted(names, keys), max(0, len(names) - 1))
                    found = names[place] == keys if len(names) else np.zeros(len(keys), dtype=bool)
                    worth = np.where(found, value[place], 0.0) if len(names) else np.zeros(len(keys))
                    sums[kind] = np.bincount(doc, weights=worth[at], minlength=b - a).astype(np.float64)  # without keys bincount gives integers
                    known[kind] = np.bincount(doc, weights=found[at], minlength=b - a).astype(np.int64)
                    amount[kind] = np.bincount(doc, minlength=b - a)
                    rest = ~found[at]
                    pair = np.stack([doc[rest], key[rest]])
                    order = np.lexsort(pair[::-1])
                    pair = pair[:, order]
                    new = np.ones(pair.shape[1], dtype=bool)
                    new[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)
                    first = np.flatnonzero(new)
                    late.append((kind, pair[0][first], pair[1][first], np.diff(np.append(first, len(new)))))
                n = b - a
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, hashes, batch.column(3)[a:b], pa.array(amount[TOKEN]), pa.array(amount[STRING]), pa.array(known[TOKEN]), pa.array(sums[TOKEN]), pa.array(sums[STRING]), pa.nulls(n, pa.int32()), none, none], COLUMNS
                )
                for kind, doc, key, times in late:
                    if len(doc):
                        take, m = pa.array(doc), len(doc)
                        empty = pa.nulls(m, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(take), hashes.take(take), pa.nulls(m, pa.bool_()), empty, empty, empty, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(np.full(m, kind, dtype=np.int32)), pa.array(key), pa.array(times)], COLUMNS
                        )

    met = docs.select("doc_id", "row", "text", "train").select("doc_id", "row", "text", "train").mapInArrow(
        run, "doc_id long, row long, train boolean, n long, bytes long, known long, tokens double, strings double, kind int, key long, times long"
    )
    # Rows of documents meet nothing; they are spread by their own hash, as a kind of its own.
    met = met.withColumn("_kind", F.coalesce("kind", F.lit(-1))).withColumn("_key", F.coalesce("key", "row"))
    seldom = seldom.select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), "n", "value").withColumnRenamed("n", "_n")
    joined = met.join(seldom, ["_kind", "_key"], "left")
    worth = lambda k, extra: F.when(F.col("kind") == k, F.col("times") * F.coalesce(extra, F.lit(0.0)))
    total = joined.groupBy("doc_id", "row").agg(
        F.count("train").alias("copies"), F.max("train").alias("train"), F.max("n").alias("n"), F.max("bytes").alias("bytes"),
        F.sum(F.coalesce("known", F.when((F.col("kind") == TOKEN) & F.col("_n").isNotNull(), F.col("times")), F.lit(0))).alias("known"),
        F.sum(F.coalesce("tokens", worth(TOKEN, F.col("value")), F.lit(0.0))).alias("tokens"),
        F.sum(F.coalesce("strings", worth(STRING, F.col("value")), F.lit(0.0))).alias("strings"),
    )
    n_tokens = F.col("n") + 1
    out = total.select(
        "doc_id", (~F.col("train")).alias("held_out"), n_tokens.cast("long").alias("n_tokens"), "copies",
        (F.col("known") / F.col("copies") + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("tokens") / F.col("copies") + math.log10(ends + 1) - n_tokens * math.log10(n_all + distinct + 1)).alias("base_score"),
        (F.col("strings") / F.col("copies") / math.log(10)).alias("score"),
        (-F.col("strings") / F.col("copies") / math.log(2) / F.col("bytes")).alias("bits_per_byte"),
    )
    # Repeated rows were summed together; they are listed again.
    return out.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies", "_copy")


COLUMNS = ["doc_id", "row", "train", "n", "bytes", "known", "tokens", "strings", "kind", "key", "times"]
