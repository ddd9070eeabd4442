"""Byte-level BPE encoding and decoding, by DuckDB queries inside each partition.

Encoding: texts are cut into pieces which the split pattern can't straddle, pieces into words by the
pattern. Words not met before become rows (word, position, token), one for each byte; a recursive query
joins neighbouring tokens with the merge table and contracts each word's leftmost pair of minimum
rank until no pair is left. In words over LONG bytes a round contracts more than one pair: all those
which the leftmost minimum would come to in any case, as no lower pair is in reach of a token's length. Decoding: (text, position, id) rows join the vocabulary, and an ordered
aggregation joins the pieces.

The merge table holds each pair of tokens whose concatenation is a token, with the latter's id as rank.
A word that is a token as a whole is taken as such, as tiktoken does. Queries are bounded by words and bytes; a
single word beyond that has a query of its own, with memory in proportion.

Edge cases: null and empty texts have no tokens and decode to nothing; a null id column stays null;
repeated rows are encoded each; very long texts and words are encoded whole; an empty table gives an empty result; other columns are ignored.
Decoding ids outside the vocabulary raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 64
#: Words and bytes in one recursive query, ids in one decoding query, bytes of cached pieces (of either generation), and characters handled at a time.
WORDS, BYTES, IDS, CACHED, CHARS = 40_000, 400_000, 300_000, 180_000_000, 3_000_000
#: Megabytes that DuckDB may take, and bytes for each byte of a longer query.
MEMORY, EACH = 250, 400

# low: rank and place (below LONG) of a word's least pair.
MERGE = """
WITH RECURSIVE step AS (
  SELECT wid, pos, tok, lead(tok) OVER w AS next, lag(pos) OVER w AS before, false AS done FROM start WINDOW w AS (PARTITION BY wid ORDER BY pos)
  UNION ALL
  (WITH pairs AS (SELECT p.*, m.rank * 64 + p.pos AS low FROM step p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next WHERE NOT done),
  least AS (SELECT wid, min(low) AS low FROM pairs GROUP BY wid),
  kept AS (
    SELECT p.wid, pos, CASE WHEN least.low & 63 = pos THEN least.low >> 6 ELSE tok END AS tok, least.low IS NULL AS done
    FROM pairs p JOIN least USING (wid) WHERE least.low IS NULL OR before IS NULL OR before <> least.low & 63
  )
  SELECT wid, pos, tok, lead(tok) OVER w, lag(pos) OVER w, done FROM kept WINDOW w AS (PARTITION BY wid ORDER BY pos))
)
SELECT wid, tok FROM step WHERE done ORDER BY wid, pos
"""
# low, first: the least rank within reach, by pairs whose token has lower pairs with its neighbours (wild) first, and by place.
# Of a run of pairs of one rank every second is contracted, if no pair in reach of the run so far is lower or wild.
# A wild pair is contracted only as the leftmost least in reach.
MERGE_LONG = """
WITH RECURSIVE step AS (
  SELECT wid, pos, tok, false AS done FROM start
  UNION ALL
  (WITH p AS (SELECT wid, pos, tok, lag(tok) OVER w AS prev, lead(tok) OVER w AS next, lead(tok, 2) OVER w AS after FROM step WHERE NOT done WINDOW w AS (PARTITION BY wid ORDER BY pos)),
  r AS (
    SELECT wid, pos, tok, rank, lower_left.t IS NOT NULL OR lower_right.t IS NOT NULL OR coalesce(twice, false) AS wild FROM p LEFT JOIN merges ON l = tok AND r = next
    LEFT JOIN lower_left ON lower_left.t = rank AND lower_left.n = prev LEFT JOIN lower_right ON lower_right.t = rank AND lower_right.n = after
  ),
  s AS (
    SELECT wid, pos, tok, rank, row_number() OVER w AS i, lag(rank) OVER w IS NOT DISTINCT FROM rank AS again,
      min(rank::BIGINT * 2 + (NOT wild)::INT) OVER reach AS low, min(rank::BIGINT * 4294967296 + pos) OVER reach AS first
    FROM r WINDOW w AS (PARTITION BY wid ORDER BY pos), reach AS (PARTITION BY wid ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)
  ),
  t AS (
    SELECT wid, pos, tok, rank, i, first, max(CASE WHEN NOT again THEN i END) OVER w AS head,
      max(CASE WHEN low <> rank::BIGINT * 2 + 1 OR rank IS NULL THEN i END) OVER w AS off, bool_or(rank IS NOT NULL) OVER (PARTITION BY wid) AS more
    FROM s WINDOW w AS (PARTITION BY wid ORDER BY pos ROWS UNBOUNDED PRECEDING)
  ),
  h AS (SELECT *, coalesce(coalesce(off < head, true) AND (i - head) % 2 = 0 OR first = rank::BIGINT * 4294967296 + pos, false) AS hit FROM t)
  SELECT wid, pos, CASE WHEN hit THEN rank ELSE tok END, NOT more FROM (SELECT *, lag(hit, 1, false) OVER (PARTITION BY wid ORDER BY pos) AS gone FROM h) WHERE NOT gone)
)
SELECT wid, tok FROM step WHERE done ORDER BY wid, pos
"""
JOIN = "SELECT doc, count(*) AS n, string_agg(piece, '' ORDER BY pos) AS text FROM given JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


class Codec:
    """Encoder and decoder of one rank file; each Python worker keeps its own."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        for setting in ("allocator_flush_threshold", "allocator_bulk_deallocation_flush_threshold"):
            self.db.execute(f"SET {setting} = '1MB'")  # else an idle worker keeps what its queries took
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges, vocabulary = pa.table(dict(zip(("l", "r", "rank"), np.array(pairs, dtype=np.int32).reshape(-1, 3).T))), pa.table({"id": list(self.ranks.values()), "piece": [t.decode("latin-1") for t in self.ranks]})
        for name, table, columns in (("merges", merges, "*"), ("vocabulary", vocabulary, "id::INT AS id, piece")):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT {columns} FROM given")
            self.db.unregister("given")
        self.db.execute("ALTER TABLE merges ADD COLUMN twice BOOLEAN")
        self.db.execute("UPDATE merges SET twice = true WHERE EXISTS (SELECT 1 FROM merges m WHERE m.l = merges.rank AND m.r = merges.rank AND m.rank < merges.rank)")
        # Neighbours n of a token t with which it makes a pair of lower rank than its own.
        self.db.execute("CREATE TABLE lower_left AS SELECT r AS t, l AS n FROM merges WHERE rank < r")
        self.db.execute("CREATE TABLE lower_right AS SELECT l AS t, r AS n FROM merges WHERE rank < l")
        # Which bytes each token has, as 256 bits.
        self.sizes, self.bits = np.array([len(t) for t in self.ranks]), np.zeros((len(self.ranks), 256), dtype=bool)
        self.bits[np.repeat(np.arange(len(self.ranks)), self.sizes), np.frombuffer(b"".join(self.ranks), dtype=np.uint8)] = True
        self.bits = np.packbits(self.bits, axis=1)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    # Where a space stands between two other characters, a match of the pattern begins.
    _odd = re.compile(r"\s | \s|^ | $")
    _cut = re.compile(r"(?<=\S)(?= \S)")

    def pieces(self, text: str) -> list[str]:
        """The text in pieces that can be split into words one by one."""
        if self._odd.search(text):
            return self._cut.split(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else []

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, as bytes."""
        lengths = np.array([len(w) for w in words])
        wid = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(wid)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        self.db.register("start", pa.table({"wid": wid, "pos": pos, "tok": self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]}))
        query = MERGE
        if long := int(lengths.max()) > LONG:
            # No token of the words' bytes is longer, so no chain of merges comes from farther away.
            met = np.packbits(np.bincount(np.frombuffer(b"".join(words), dtype=np.uint8), minlength=256) > 0)
            query = MERGE_LONG.replace("{reach}", str(int(self.sizes[~(self.bits & ~met).any(axis=1)].max())))
        if long and len(wid) > BYTES:
            self.db.execute(f"SET memory_limit = '{MEMORY + len(wid) * EACH // 1_000_000}MB'")
        out = self.db.sql(query).to_arrow_table()
        if long and len(wid) > BYTES:
            self.db.execute(f"SET memory_limit = '{MEMORY}MB'")
        self.db.unregister("start")
        ids, ends = out.column("tok").to_numpy().astype("<u4"), np.cumsum(np.bincount(out.column("wid").to_numpy(), minlength=len(words)))
        data, at = ids.tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *at], at)]

    def _renew(self, pieces: set[str]) -> set[str]:
        """Those of the pieces that the older generation has; they are in the younger one then."""
        met = pieces & self.old.keys()
        self.cache |= {p: self.old[p] for p in met}
        self._weigh({p: self.old[p] for p in met})
        return met

    def _weigh(self, known: dict[str, bytes]) -> None:
        self.held += sum(map(len, known)) + sum(map(len, known.values())) + 180 * len(known)

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of the pieces into the cache."""
        split = {p: self.pattern.findall(p) for p in pieces}
        words = {w for ws in split.values() for w in ws} - self.cache.keys()
        fresh = {w: w.encode() for w in words - self._renew(words)}
        known, todo = {}, []
        for w, b in fresh.items():
            if (r := self.ranks.get(b)) is not None:
                known[w] = np.array([r], dtype="<u4").tobytes()
            else:
                todo.append((w, b))
        for some in ([x for x in todo if len(x[1]) <= LONG], [x for x in todo if len(x[1]) > LONG]):
            first = size = 0
            for i, (_, b) in enumerate(some):
                size += len(b)
                if size + (len(some[i + 1][1]) if i + 1 < len(some) else BYTES) > BYTES or i + 1 - first == WORDS:
                    part = some[first : i + 1]
                    known |= zip((w for w, _ in part), self._merge([b for _, b in part]))
                    first, size = i + 1, 0
        self.cache |= known
        for p, ws in split.items():
            if p not in self.cache:
                known[p] = self.cache[p] = b"".join(map(self.cache.__getitem__, ws))
        self._weigh(known)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if self.held > CACHED:  # what isn't met again while the younger generation grows is forgotten
            self.old, self.cache, self.held = self.cache, {}, 0
        cut = [self.pieces(t) if t else [] for t in texts]
        fresh = set().union(*cut) - self.cache.keys()
        fresh -= self._renew(fresh)
        if fresh:
            self._learn(fresh)
        return [b"".join(map(self.cache.__getitem__, c)) for c in cut]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes for ids as encode gives them."""
        ids = np.frombuffer(b"".join(coded), dtype="<u4")
        lengths = np.array([len(c) // 4 for c in coded], dtype=np.int64)
        doc = np.repeat(np.arange(len(coded)), lengths)
        out: list[list[bytes]] = [[] for _ in coded]
        for i in range(0, len(ids), IDS):
            part = slice(i, i + IDS)
            self.db.register("given", pa.table({"doc": doc[part].astype(np.int32), "pos": np.arange(len(ids[part]), dtype=np.int32), "id": ids[part].astype(np.int32)}))
            got = self.db.sql(JOIN).to_arrow_table().to_pydict()
            self.db.unregister("given")
            if sum(got["n"]) != len(ids[part]):
                raise ValueError("an id isn't in the vocabulary")
            for d, text in zip(got["doc"], got["text"]):
                out[d].append(text.encode("latin-1"))
        return [b"".join(x) for x in out]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _groups(rows: list, weigh) -> Iterator[slice]:
    """Slices of rows of about CHARS characters."""
    first = held = 0
    for i, row in enumerate(rows):
        held += weigh(row)
        if held >= CHARS:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(rows):
        yield slice(first, len(rows))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each text."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for s in _groups(texts, lambda t: len(t or "")):
                ids = [np.frombuffer(c, dtype="<u4").astype(np.int32) for c in own.encode(texts[s])]
                yield pa.RecordBatch.from_arrays([keys[s.start : s.stop], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (binary) of rows of doc_id and ids; null ids decode to nothing."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1).to_pylist()
            for s in _groups(ids, lambda x: 4 * len(x or [])):
                yield pa.RecordBatch.from_arrays([keys[s.start : s.stop], pa.array(own.decode([np.array(x or [], dtype="<u4").tobytes() for x in ids[s]]), pa.binary())], ["doc_id", "decoded"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, then decoded from the ids."""

    def run(batches):
        own = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_pylist()
            for s in _groups(sizes, int):
                coded = own.encode(texts[s.start : s.stop].to_pylist())
                plain = own.decode(coded)
                yield pa.RecordBatch.from_arrays(
                    [keys[s.start : s.stop], pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(map(sha, coded), pa.string()), pa.array(map(sha, plain), pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
