"""Operators and the pipeline's stages against plain brute force on small fixtures."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlframe.llm import bwt_dedup, ctw, ngram_join, nn_descent, toxicity
from crawlframe.llm.hashing import U

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts], SCHEMA)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def sets(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 90 * len(a | b)


def joined(texts):
    """(doc_id, n_shingles, n_similar, component_id) by comparing all pairs."""
    s = [sets(t) for _, t in texts]
    near = [[j for j in range(len(s)) if j != i and linked(s[i], s[j])] for i in range(len(s))]
    out = []
    for i in range(len(s)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((texts[i][0], len(s[i]), len(near[i]), min(texts[j][0] for j in seen)))
    return out


def near_texts(seed=0, n=14):
    random = np.random.default_rng(seed)
    word = lambda: "".join(random.choice(list("abcdefgh"), random.integers(2, 6)))
    texts = []
    for size in (4, 5, 6, 12, 13, 14, 25, 60, 150, 400):
        base = [word() for _ in range(size)]
        for k in range(n):
            own = list(base)
            for _ in range(random.integers(0, 1 + max(1, size // 60))):
                own[random.integers(size)] = word()
            cut = random.integers(0, 1 + size // 20)
            texts.append(" ".join(own[cut:] if k % 2 else own[: size - cut]))
        texts.append(base[0].upper() + " " + " ".join(base[1:]))
    return [(int(i), t) for i, t in zip(random.permutation(10_000)[: len(texts)], texts)]


@pytest.mark.parametrize("room", [2_000_000, 300])
def test_near_pairs(spark, room):
    texts = near_texts()
    want = joined(texts)
    assert sum(n > 0 for _, _, n, _ in want) > 60 and len({s for _, s, n, _ in want if n}) > 8
    assert sorted(map(tuple, ngram_join.similar(table(spark, texts), room=room).collect())) == sorted(want)


def test_divide_skip():
    """Long lists, and groups in which the merged lists are shorter than the number of sets."""
    random = np.random.default_rng(4)
    fresh = lambda n: random.integers(0, 1 << 40, n).astype(U)
    common = fresh(400)
    groups = [np.concatenate([common[:30], fresh(40)]) for _ in range(60)]
    own = [np.unique(np.concatenate([g, fresh(random.integers(0, 9))])) for g in groups for _ in range(3)]
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if 100 * len(np.intersect1d(own[i], own[j])) >= 90 * len(np.union1d(own[i], own[j]))}
    assert want and set(ngram_join.divide_skip(own)) == want
    assert {(i, j) for i, j in ngram_join.divide_skip(own[:50], own[50:])} == {(j - 50, i) for i in range(50) for j in range(50, len(own)) if (i, j) in want}


def context_tree(train, texts, depth):
    """Natural log of each text's probability by a context tree kept as dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    decisions = lambda byte: [((1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1) for j in range(8)]

    def bytes_of(t):
        data = b"\0" * depth + lower(t).encode() + b"\0"
        return [(data[i - depth : i], data[i]) for i in range(depth, len(data))]

    for t in train:
        for context, byte in bytes_of(t):
            for node, bit in decisions(byte):
                for d in range(depth + 1):
                    counts[context[depth - d :], node][bit] += 1
    children = defaultdict(set)
    for context, node in counts:
        if context:
            children[context[1:], node].add(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    held = {}

    def weighted(context, node):
        if (context, node) not in held:
            own = kt(*counts.get((context, node), (0, 0)))
            if len(context) == depth:
                held[context, node] = own, 1.0
            else:
                below = sum(weighted(c, node)[0] for c in children.get((context, node), ()))
                both = np.logaddexp(own, below) - math.log(2)
                held[context, node] = both, math.exp(own - math.log(2) - both)
        return held[context, node]

    out = []
    for t in texts:
        total = 0.0
        for context, byte in bytes_of(t):
            for node, bit in decisions(byte):
                p = None
                for d in range(depth, -1, -1):
                    c = context[depth - d :]
                    n = counts.get((c, node), (0, 0))
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    share = weighted(c, node)[1]
                    p = own if p is None else share * own + (1 - share) * p
                total += math.log(p)
        out.append(total)
    return out


@pytest.mark.parametrize("room", [1_500_000, 40])
def test_context_tree(spark, room):
    texts = [(i, t) for i, t in enumerate(["the cat sat", "The cat sat on the mat", None, "", "  ", "abracadabra abra", "mat é 漢 cat", "the the the", "cat\nsat \t on", "zebra", "the cat sat", "cab " * 40])]
    texts += [(11, "cab " * 40), (None, "the mat")]
    train = [t for i, t in texts if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    words = Counter(w for t in train for w in [*WORD.findall(lower(t)), None])
    n, v = sum(words.values()), len(words)
    want = []
    for (i, t), score in zip(texts, context_tree(train, [t for _, t in texts], 3)):
        own = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        held_out = zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
        want.append((i, held_out, len(own), sum(words[w] > 0 for w in own), n, base, score / math.log(10), -score / math.log(2) / (len((t or "").encode()) + 1)))
    got = [tuple(r) for r in ctw.score(table(spark, texts), depth=3, room=room).collect()]
    key = lambda r: (r[0] is None, r[0], r[2])
    assert any(r[1] for r in want) and [r[:5] for r in sorted(got, key=key)] == [r[:5] for r in sorted(want, key=key)]
    assert np.allclose([r[5:] for r in sorted(got, key=key)], [r[5:] for r in sorted(want, key=key)], atol=1e-9)


def test_logistic():
    """The models' weights solve the dense Newton system's optimum."""
    random = np.random.default_rng(1)
    x, more = (random.random((300, 12)) < 0.3).astype(float), random.random((300, 1))
    y, weight = (random.random(300) < 0.2 + 0.5 * x[:, 0]).astype(float), random.random(300)
    row, word = np.nonzero(x)
    w, c, b = toxicity.fit_logistic(toxicity.Cells(300, row, word), 12, more, y, weight)
    full, dense = np.column_stack([x, more, np.ones(300)]), np.zeros(14)
    ridge = np.append(np.full(13, 0.3), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ dense))
        dense += np.linalg.solve((full * (weight * p * (1 - p))[:, None]).T @ full + np.diag(ridge), full.T @ (weight * (y - p)) - ridge * dense)
    assert np.allclose(np.concatenate([w, c, [b]]), dense, atol=1e-4)


def test_chain_predicts_by_words(spark):
    """Probabilities of whole texts are those of a plain evaluation of the chain, the toxic link fed with the one before."""
    rows = [(i, ("dull words " if i % 2 else "bright words ") + ("vile " if i % 3 == 0 else "mild ") + f"w{i} é{i}") for i in range(80)] + [(80, None), (81, "bright VILE"), (82, "vile " * 300_000)]
    labels = spark.createDataFrame([(i, (i + 1) % 2, int(i % 3 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(table(spark, rows), toxicity.categories(labels), toxicity.CHAIN)
    assert len(chain) == 2 and len(chain[1].chain) == 1
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.judge(table(spark, rows), labels).collect()}
    for i, t in rows:
        held = set(toxicity.word_hashes([(t or "").encode()])[0].tolist())
        earlier = []
        for link in chain:
            z = link.intercept + sum(a * b for a, b in zip(link.chain, earlier)) + sum(float(w) for h, w in zip(link.words.tolist(), link.weights) if h in held)
            earlier.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert np.allclose(got[i], earlier, atol=1e-9)
    assert got[82][1] > 0.5 > got[80][1]


def test_vectors_by_all_pairs(spark):
    random = np.random.default_rng(8)
    centres = random.standard_normal((30, 16))
    x = [centres[i % 30] + (0.02 + 0.03 * (i % 5)) * random.standard_normal(16) for i in range(300)]
    rows = [(i, v.tolist(), i % 2 if i % 11 else 3) for i, v in enumerate(x)] + [(300, x[0].tolist(), 0), (0, x[0].tolist(), 3)]
    m = np.array([v for _, v, _ in rows])
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    label = np.array([k for *_, k in rows])
    near = (m @ m.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    want = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        want.append((rows[i][0], int(near[i].sum()), low, rows[i][0] == low))
    assert near.sum() > 500
    assert sorted(map(tuple, nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())) == sorted(want)


def cut_repeats(texts, window=400):
    every = Counter(t.encode()[k : k + window] for _, t in texts for k in range(len(t.encode()) - window + 1))
    out = {}
    for i, t in texts:
        data = t.encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - window + 1):
            if every[data[k : k + window]] > 1:
                gone[k : k + window] = True
        out[i] = bytes(np.frombuffer(data, np.uint8)[~gone]).decode(errors="ignore")
    return out


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on what the one before kept; columns that clash with the operators' own names pass through."""
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    import corpus_pipeline

    random = np.random.default_rng(6)
    fresh = lambda n: " ".join("".join(random.choice(list("abcdefghé"), random.integers(2, 8))) for _ in range(n))
    shared = fresh(110)
    texts = [fresh(int(random.integers(1, 120))) for _ in range(40)]
    texts += [fresh(30) + " " + shared + " " + fresh(20), shared + " " + fresh(60), texts[3], texts[3], texts[7] + " more", "", None, "vile " + fresh(40), fresh(20) + " vile " + fresh(9)]
    texts = [t if t is None or i % 4 or i >= 40 else "vile " + t for i, t in enumerate(texts)]
    docs = table(spark, list(enumerate(texts)))
    for name in ("_k1", "_starts", "_id", "_hash", "_at", "size", "_size", "_shard", "class", "row"):
        docs = docs.withColumn(name, F.col("doc_id") * 2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts) if i < 46], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, now = dict(corpus_pipeline.STAGES), docs
    assert list(stages) == ["toxicity", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    seen = []
    for name, stage in stages.items():
        before = now.collect()
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"out{len(seen)}"))
        now = spark.read.parquet(str(tmp_path / f"out{len(seen)}"))
        seen.append((before, now.collect()))
        if name != list(stages)[-1]:
            assert now.columns == docs.columns
    (_, clean), (_, single), (_, cut), (_, mixed), (_, coded) = seen
    assert {r.doc_id for r in clean} == {i for i, t in enumerate(texts) if "vile" not in (t or "")}
    pairs = {i: low for i, _, _, low in joined([(r.doc_id, r.text) for r in clean])}
    assert {r.doc_id for r in single} == {i for i, low in pairs.items() if i == low} and len(single) < len(clean)
    left = cut_repeats([(r.doc_id, r.text or "") for r in single])
    assert {r.doc_id: (r.text or "") for r in cut} == left and any(len(left[r.doc_id]) < len(r.text or "") for r in single)
    assert all(r.n_chars == len(r.text or "") for r in cut)
    words = {r.doc_id: WORD.findall(r.text or "") for r in cut}
    taken = Counter()
    for r in mixed:
        own = WORD.findall(r.text)
        assert own == words[r.doc_id] or set(own) <= set(words[r.doc_id])
        taken[r.doc_id] += len(own)
    assert all(n <= 3 * len(words[i]) for i, n in taken.items())
    size = Counter()
    for r in cut:
        size[r.source] += len(words[r.doc_id])
    level, weights, capped = sum(size.values()), dict(zip(sorted(size), (1, 2, 3))), set()
    while True:
        room = level - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else room * weights[s] / sum(w for x, w in weights.items() if x not in capped) for s in size}
        more = {s for s in size if target[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    assert all(abs(sum(n for i, n in taken.items() if f"s{i % 3}" == s) - target[s]) <= 1 for s in size)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, len(ids := enc.encode_ordinary(r.text)), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    assert sorted(map(tuple, coded)) == want


def test_same_removals_as_brute_force_on_tables_of_copies(spark):
    """A passage in hundreds of texts, of which a third are copies."""
    random = np.random.default_rng(2)
    fresh = lambda n: "".join(random.choice(list("abcdefgh "), n))
    hot = fresh(700)
    texts = [(i, fresh(60) + hot[i % 5 : 600 + i % 90] + fresh(30)) for i in range(120)]
    texts += [(1000 + i, texts[0][1]) for i in range(60)]
    want = cut_repeats(texts)
    for room in (2 << 20, 5000):
        got = {r.doc_id: r for r in bwt_dedup.digest(table(spark, texts), room=room).collect()}
        assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
        assert all(r.n_chars == len(want[i]) for i, r in got.items())
