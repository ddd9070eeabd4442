"""Toxicity by classifier chains.

The chain's categories are predicted one after the other. Each category has a logistic model over the
presence of words, which also takes the probabilities of the categories before it. For training, those
are out-of-fold predictions, so later models learn from probabilities of the kind they meet later.

Words are runs of letters and digits, A-Z lower-cased; a longer word's first bytes count as another word. A model's words are those whose presence differs
most between the classes of its own training rows; their number is chosen out of fold. Training takes at most `most` labelled rows with
at most `room` distinct words in all, those with the least hash of doc_id; everything else covers whole tables and texts.

The labels hold one toxicity category; its chain starts with low quality, which many labels hold too.

Edge cases: null and empty texts have no words and get the models' base probability; labels that are null
or for missing documents are left out, of contradicting labels the larger counts; without labels of both
classes a category's probability is the share of positives (0 without any); repeated rows are judged each, and of
rows that repeat a doc_id one is trained on; very long texts are judged whole; words that tell equally are taken by hash;
an empty table gives an empty result; other columns are ignored, and kept by `keep_clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, settle
from .hashing import U, lower, mix, prefix, spans

FOLDS = 5
#: A model's words are in so many rows at least, near copies counting as one.
LEAST = 3
STEM = 6
CHARS = 1_000_000
_codes = np.arange(256)
_GAP = (_codes < 128) & ~(((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and each longer word's first STEM bytes, and the text each belongs to."""
    data = lower(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8))
    edge = np.diff(np.concatenate([[True], _GAP[data]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    doc, sums, stem = np.searchsorted(bounds, start, side="right"), prefix(data), start + STEM < end
    stems = spans(sums, start[stem], start[stem] + STEM) ^ U(0x5851F42D4C957F2D)
    return np.concatenate([spans(sums, start, end), stems]), np.concatenate([doc, doc[stem]])


class Cells:
    """Which of the chosen words each of n rows has, as pairs (row, place of the word): memory follows the words met."""

    def __init__(self, n: int, row: np.ndarray, word: np.ndarray):
        self.n, self.row, self.word = n, row, word

    def first(self, size: int) -> Cells:
        some = self.word < size
        return Cells(self.n, self.row[some], self.word[some])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.word], minlength=self.n)


def fit_logistic(cells: Cells, size: int, more: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of `size` words and of the columns of `more`, and the intercept; rows count by `weight`.

    Newton's method with a ridge on the weights; its steps are solved by conjugate gradients, so no matrix of words by words is made.
    """
    k = more.shape[1]
    penalty = np.concatenate([np.full(size + k, ridge), [1e-6]])

    def forward(v: np.ndarray) -> np.ndarray:
        return cells.sums(v) + more @ v[size : size + k] + v[-1]

    def back(u: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(cells.word, weights=u[cells.row], minlength=size)[:size], more.T @ u, [u.sum()]])

    w = np.zeros(size + k + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        curve = weight * p * (1 - p)
        scale = np.concatenate([np.bincount(cells.word, weights=curve[cells.row], minlength=size)[:size], (more * more).T @ curve, [curve.sum()]]) + penalty
        residual = back(weight * (y - p)) - penalty * w
        step, z, target = np.zeros_like(w), residual / scale, 1e-3 * np.sqrt(residual @ (residual / scale))
        direction, rz = z.copy(), residual @ z
        for _ in range(200):
            if rz <= target * target:
                break
            turned = back(curve * forward(direction)) + penalty * direction
            length = rz / (direction @ turned)
            step += length * direction
            residual = residual - length * turned
            z = residual / scale
            rz, before = residual @ z, rz
            direction = z + rz / before * direction
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:size], w[size : size + k], float(w[-1])


def telling_words(word: np.ndarray, row: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """Of words 0 to n - 1 those whose presence in the rows differs most between the classes, the most telling first; rows count by `weight`."""
    positive, total = float((weight * y).sum()), float(weight.sum())
    if positive == 0 or positive == total:
        return np.zeros(0, dtype=np.int64)
    hit, both = (np.bincount(word, weights=w[row], minlength=n) for w in (y * weight, weight))
    p, q, share = hit / positive, (both - hit) / (total - positive), both / total
    score = np.abs(p - q) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / positive + 1 / (total - positive)))
    chosen = np.argsort(-np.where(both >= LEAST, score, -1), kind="stable")[:most]
    return chosen[both[chosen] >= LEAST]


class Link:
    """One category's model: words, their weights, weights of earlier probabilities, intercept. cells: the words in the rows; rows of weight 0 aren't learnt from."""

    def __init__(self, words: np.ndarray, cells: Cells, y: np.ndarray, weight: np.ndarray, earlier: np.ndarray):
        self.words, self.weights, self.chain = np.zeros(0, dtype=U), np.zeros(0), np.zeros(earlier.shape[1])
        positive, total = float((weight * y).sum()), float(weight.sum())
        share = positive / total if total else 0.0
        self.intercept = float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share == 1 else -30.0)
        self.own = np.full(cells.n, self.intercept)
        if not 0 < share < 1:
            return
        weights, self.chain, self.intercept = fit_logistic(cells, len(words), earlier, y, weight)
        self.own = cells.sums(weights) + earlier @ self.chain + self.intercept
        order = np.argsort(words)
        self.words, self.weights = words[order], weights[order]

    def held_out(self) -> np.ndarray:
        """Probabilities of the rows it was made with, those of weight 0 among them; given once."""
        own, self.own = self.own, None
        return 1 / (1 + np.exp(-np.clip(own, -30, 30)))

    def predict(self, words: np.ndarray, doc: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of n texts, whose words and their texts are given."""
        z = np.full(n, self.intercept) + earlier @ self.chain
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            met = self.words[at] == words
            pairs = np.unique(doc[met] * len(self.words) + at[met])
            z += np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def near_copies(rows: list[np.ndarray]) -> np.ndarray:
    """A number for each row, mostly the same for near copies: it is made of the row's least word hashes."""
    return np.array([mix(np.sort(mix(r))[:3]).sum(dtype=U) if len(r) else 0 for r in rows], dtype=U)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, sizes: tuple[int, ...] = (16, 64, 256)) -> list[Link]:
    """A model for each column of labels. rows: distinct word hashes of each text."""
    return fit_held_out(rows, labels, sizes)[0]


def fit_held_out(rows: list[np.ndarray], labels: np.ndarray, sizes: tuple[int, ...] = (16, 64, 256)) -> tuple[list[Link], np.ndarray]:
    """A model for each column of labels, and their out-of-fold predictions.

    Near copies share a fold and one row's weight. The number of words is the one whose out-of-fold
    predictions have the least loss: one of `sizes`, or, as long as the largest number tried is the best
    and there are more words, its double. Those predictions go on to the later categories.
    """
    chain, earlier = [], np.zeros((len(rows), 0))
    flat, doc = (np.concatenate(rows) if rows else np.zeros(0, dtype=U)), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, group, count = np.unique(near_copies(rows), return_inverse=True, return_counts=True)
    weight, fold = (1 / count[group] if len(rows) else np.zeros(0)), group % FOLDS
    every, at = np.unique(flat, return_inverse=True)
    known = np.bincount(at, weights=weight[doc], minlength=len(every)) >= LEAST  # rarer words are no model's
    number, met = np.cumsum(known) - 1, known[at]
    every, word, row = every[known], number[at[met]], doc[met]
    del flat, doc, at

    def cells(words: np.ndarray) -> Cells:
        place = np.full(len(every), -1)
        place[words] = np.arange(len(words))
        some = place[word] >= 0
        return Cells(len(rows), row[some], place[word[some]])

    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        held_out, loss, tried = {}, {}, list(sizes)
        while tried:
            held_out |= {size: np.zeros(len(rows)) for size in tried}
            found = 0
            for k in range(FOLDS):
                mine = fold == k
                rest = np.where(mine, 0.0, weight)
                words = telling_words(word, row, len(every), y, rest, max(tried))
                own, found = cells(words), max(found, len(words))
                for size in tried:
                    held_out[size][mine] = Link(every[words[:size]], own.first(size), y, rest, earlier).held_out()[mine]
            loss |= {size: -(weight * np.log(np.maximum(np.where(y == 1, held_out[size], 1 - held_out[size]), 1e-9))).sum() for size in tried}
            best = min(loss, key=loss.get)
            tried = [2 * best] if best == max(loss) and found >= best else []
        words = telling_words(word, row, len(every), y, weight, best)
        chain.append(Link(every[words], cells(words), y, weight, earlier))
        chain[-1].own = None
        earlier = np.column_stack([earlier, held_out[best]])
    return chain, earlier


def train(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = 10_000, room: int = 20_000_000) -> list[Link]:
    """labels: doc_id and a 0/1 column for each category. The sample: the first rows by the hash of doc_id, at most `most`, with at most `room` distinct words in all."""
    known = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
    known = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most)  # the documented bound of the training sample

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column(1), CHARS):
                words, doc = word_hashes([x or b"" for x in batch.column(1)[a:b].cast(pa.binary()).to_pylist()])
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(1, b - a))
                sets = [np.unique(w).view(np.int64) for w in np.split(words[order], cuts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.list_(pa.int64())), *(c[a:b] for c in batch.columns[2:])], ["doc_id", "words", "hash", "place", *categories])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.xxhash64("text").alias("hash"))
    met = columns.join(F.broadcast(known.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")  # `most` rows of numbers
    read = met.select("doc_id", "text", "hash", "place", *categories).mapInArrow(run, "doc_id long, words array<long>, hash long, place long, " + ", ".join(f"`{c}` double" for c in categories))
    # Of rows that repeat a doc_id, the one with the least hash counts.
    own = settle(read.groupBy("doc_id").agg(F.min_by(F.struct("words", "place", *categories), "hash").alias("_r")).select("doc_id", "_r.*"), "labelled")
    sizes = own.select("place", "doc_id", F.size("words").alias("n")).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    fit = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), room, side="right"))
    last = sizes.column("place")[fit - 1].as_py() if fit else None
    got = own.filter(F.col("place") <= F.lit(last).cast("long")).toArrow().sort_by("doc_id")
    flat = got.column("words").combine_chunks()
    rows = [np.asarray(x, dtype=np.int64).view(U) for x in np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1])] if len(got) else []
    return fit_chain(rows, np.column_stack([got.column(c).to_numpy() for c in categories]))


def _predict(texts: pa.Array, chain: list[Link]) -> np.ndarray:
    """Probabilities of each text, a column for each category."""
    words, doc = word_hashes([x or b"" for x in texts.cast(pa.binary()).to_pylist()])
    earlier = np.zeros((len(texts), 0))
    for link in chain:
        earlier = np.column_stack([earlier, link.predict(words, doc, len(texts), earlier)])
    return earlier


def probabilities(docs: DataFrame, chain: list[Link], categories: list[str]) -> DataFrame:
    """doc_id and p_<category> of each row of documents."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # some hundreds of words for each category

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column(1), CHARS):
                got = _predict(batch.column(1)[a:b], held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(c) for c in got.T)], ["doc_id", *(f"p_{c}" for c in categories)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"`p_{c}` double" for c in categories)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {fields}")


def categories(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


CHAIN = ["low_quality", "toxic"]


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = 10_000) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic (p_toxic >= least) of each row of documents."""
    chain = train(docs, categories(labels), CHAIN, most)
    return probabilities(docs, chain, CHAIN).withColumn("toxic", F.col("p_toxic") >= least)


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = 10_000) -> DataFrame:
    """docs without those judged toxic, all columns kept. Rows are judged as they pass, about CHARS bytes of text at a time."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, categories(labels), CHAIN, most))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column(at), CHARS):
                yield batch.slice(a, b - a).filter(pa.array(_predict(batch.column(at)[a:b], held.value)[:, -1] < least))

    return docs.mapInArrow(run, docs.schema)
