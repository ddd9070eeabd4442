"""The operators against brute force on small fixtures with nulls, empties, ties and repeated rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlframe.llm import bpe, bwt_dedup, ctw, mixing, ngram_join, nn_descent, preference, quality_rules, toxicity, url_templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [(1, "the cat sat on the mat and the dog sat too " * 3), (2, "the cat sat on the mat and the dog sat too " * 3), (3, None), (4, ""), (None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "é ü  漢字 \n\n x" * 9)]


def docs(spark, rows=TEXTS):
    df = spark.createDataFrame([(i, t, "en", None if i == 5 else f"s{(i or 0) % 2}", len(t or ""), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, word string")
    return df


def sets(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_join(spark):
    got = sorted(map(str, ngram_join.similar(docs(spark)).collect()))
    want = []
    for i, t in TEXTS:
        a = sets(t)
        near = [j for j, u in TEXTS if a and (b := sets(u)) and 100 * len(a & b) >= 90 * len(a | b)]
        want.append((i, len(a), max(0, len(near) - 1), min((j for j in near if j is not None), default=i)))
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, n_similar={c}, component_id={d})" for a, b, c, d in want)
    assert sorted(r.doc_id for r in ngram_join.keep_first(docs(spark)).collect()) == [1, 3, 4, 5, 6]


@pytest.mark.parametrize("room", [2 << 20, 100])
def test_dedup(spark, room):
    rows = [(i, t) for i, t in TEXTS]
    all_windows = Counter((t or "").encode()[k : k + 20] for _, t in rows for k in range(len((t or "").encode()) - 19))
    want = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - 19):
            gone[k : k + 20] |= all_windows[data[k : k + 20]] > 1
        want.append((i, len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    bwt_dedup.ANCHOR, held = 8, bwt_dedup.ANCHOR
    try:
        segments = [np.frombuffer(b"abcdefghij" * 4 + bytes([i]) * 5, dtype=np.uint8) for i in range(3)]
        assert [f.sum() > 0 for f in bwt_dedup.repeated_starts(segments, 20)] == [True] * 3
    finally:
        bwt_dedup.ANCHOR = held
    df = docs(spark, [(i, None if t is None else t * 12) for i, t in rows])
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in bwt_dedup.digest(df, room=room).collect()}
    assert (1, 12 * len(TEXTS[0][1]), 12 * len(TEXTS[0][1])) in got and (3, 0, 0) in got and (5, 60, 0) in got


@pytest.mark.parametrize("room", [2 << 20, 100])
def test_dedup_of_shared_passages(spark, room):
    random = np.random.default_rng(9)
    fresh = lambda n: "".join(random.choice(list("abcdefgh é"), n))
    a, b, c = fresh(900), fresh(500), fresh(399)
    texts = [fresh(300) + a + fresh(200), fresh(50) + a[100:700] + fresh(700) + b, b + fresh(10) + a[300:] + fresh(90), fresh(40) + c, c.encode()[:390].decode(errors="ignore") + fresh(60), fresh(30) + a[:420] + fresh(20) + a[480:], None, "", fresh(450) * 2]
    rows = list(enumerate(texts)) + [(20, fresh(30) + texts[0][:900]), (21, texts[2]), (21, texts[2])]
    every = Counter((t or "").encode()[k : k + 400] for _, t in rows for k in range(len((t or "").encode()) - 399))
    want = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - 399):
            gone[k : k + 400] |= every[data[k : k + 400]] > 1
        want.append((i, len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    assert sum(0 < n < size for _, size, n, *_ in want) >= 4
    assert sorted(tuple(r)[:5] for r in bwt_dedup.digest(docs(spark, rows), room=room).collect()) == sorted(want)


def test_mixing(spark):
    rows = [(i, "w " * (i * 37 % 300)) for i in range(60)] + [(None, "x y"), (7, None)]
    for block in (16, 512):
        got = mixing.mix_digest(docs(spark, rows), block=block).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
        for s in {(r.source_size, r.target) for r in got}:
            assert abs(sum(r.taken for r in got if (r.source_size, r.target) == s) - s[1]) <= 1
    assert mixing.mix_digest(docs(spark, rows).limit(0)).count() == 0


def test_mixing_shards(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i * 37 % 90))) for i in range(40)]
    df = docs(spark, rows).withColumn("size", F.lit(1)).withColumn("_shard", F.lit("x"))
    target = mixing.targets(mixing.measure(df))
    listed = Counter()
    for r in mixing.slots(target, 16, 0, 8).collect():
        listed[r.shard, r.source] += r.take
    frame, shard, place = mixing.mix_placed(df, 16, 0, 8)
    placed = frame.collect()
    met = Counter()
    for r in placed:
        met[r[shard], r.source] += len(r.text.split())
    assert met == listed and len({at for at, _ in met}) > 5
    got = [(r.doc_id, r.text) for r in mixing.mix_documents(df, 16, 0, 8).collect()]
    at = {}
    for r in placed:
        at.setdefault((r.doc_id, r.text), set()).add(r[shard])
    assert len(got) == len(placed) and all(min(at[a]) <= max(at[b]) for a, b in zip(got, got[1:]))


def test_mixing_draws(spark):
    """The shards' counts are those of a draw by hash, but for what is beyond a source's target; each slot of a source is used once."""
    rows = [(i, "w " * (i * 37 % 300)) for i in range(300)]
    target = mixing.targets(mixing.measure(docs(spark, rows)))
    plan = mixing.planned(target, 16).collect()
    n, draws = {r.id: r.n for r in plan}, mixing.drawn(mixing.planned(target, 16), 0, 64)
    total = sum(n.values())
    want, ends = Counter(), np.cumsum([n[i] for i in sorted(n)])
    for place in range(total):
        v = int(hashlib.md5(f"0:draw:{place}".encode()).hexdigest()[:12], 16) % total
        want[place // 64, int(np.searchsorted(ends, v, side="right")) + 1] += 1
    assert {(r.shard, r.id): r["count"] for r in mixing.shard_counts(draws, 64).collect()} == dict(want)
    got = mixing.slots(target, 16, 0, 64).collect()
    assert sorted(r.place for r in got) == list(range(total))
    names = {r.id: r.source for r in plan}
    assert Counter(r.source for r in got) == {names[i]: k for i, k in n.items()} and len({(r.source, r.epoch, r.block) for r in got}) == total
    moved = sum(abs(a - b) for a, b in ((Counter((r.shard, r.source) for r in got)[k, names[i]], want[k, i]) for k, i in want))
    assert moved < 0.1 * total


def test_codec():
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ["", "a" * 3000, " x  y\n\n z ", "<|endoftext|>", "l'été 漢字 123 ", "\x1c \x85  a"] + [t for _, t in TEXTS if t]
    coded = codec.encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [own.encode_ordinary(t) for t in texts]
    assert codec.decode(coded) == [t.encode() for t in texts]
    random = np.random.default_rng(2)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(random.choice(list(of), n))
    long = [letters(20_000), letters(5000, "ab"), "ab" * 4000, "=" * 3001, "é漢" * 500 + letters(99, "éa"), " ".join(letters(240) for _ in range(300)), "the" * 3000, letters(900, "theand"), " " * 5000, letters(65), letters(64)]
    assert [np.frombuffer(c, "<u4").tolist() for c in codec.encode(long)] == [own.encode_ordinary(t) for t in long]
    with pytest.raises(ValueError):
        codec.decode([np.array([60000], dtype="<u4").tobytes()])


def test_quality(spark):
    got = quality_rules.judge(docs(spark)).collect()
    assert len(got) == len(TEXTS) and {r.n_repeat_words for r in got if r.doc_id == 1} == {33} and not any(r.kept for r in got if r.base_failed)


def test_toxicity(spark):
    rows = [(i, ("fine words here " + ("vile " if i % 3 == 0 else "") + f"w{i}")) for i in range(90)] + [(None, None), (90, ""), (91, "so vile")]
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.judge(docs(spark, rows), labels).collect()}
    assert got[91] and not got[90] and not got[None] and all(got[i] == (i % 3 == 0) for i in range(90))
    assert toxicity.judge(docs(spark, rows), labels.limit(0)).filter("toxic").count() == 0


def test_toxicity_of_many_words():
    random = np.random.default_rng(3)
    vile, plain = (random.permutation(1 << 20)[:n].astype(np.uint64) for n in (330, 3000))
    bad = np.repeat(np.arange(330), 8)
    rows = [np.unique(np.append(random.choice(plain, 12), vile[i])) for i in bad] + [np.unique(random.choice(plain, 13)) for _ in bad]
    y = np.repeat([1, 0], len(bad))
    chain, held_out = toxicity.fit_held_out(rows, y[:, None])
    assert len(chain[0].words) > 256 and ((held_out[:, 0] >= 0.5) == y).mean() > 0.95
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    assert ((toxicity.fit_chain(rows, y[:, None])[0].predict(flat, doc, len(rows), np.zeros((len(rows), 0))) >= 0.5) == y).mean() > 0.95


def test_scores(spark):
    got = ctw.score(docs(spark), depth=2, room=5).collect()
    assert len(got) == len(TEXTS) and all(r.score < 0 and r.base_score < 0 for r in got) and {r.n_tokens for r in got if r.doc_id in (3, 4)} == {1}
    assert sorted(round(r.score, 9) for r in got) == sorted(round(r.score, 9) for r in ctw.score(docs(spark), depth=2).collect())


def test_vectors(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [1.0, 2.01], 0), (5, [1.0, 2.0], None), (6, [1.0, 2.0], 1)]
    got = sorted(map(tuple, nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 1, False), (5, 0, 5, True), (6, 0, 6, True)]


@pytest.mark.parametrize("enough", [0.99, 1.1])
def test_vectors_between_full_lists(spark, monkeypatch, enough):
    monkeypatch.setattr(nn_descent, "TRIES", 1)
    random = np.random.default_rng(5)
    base, other = np.eye(64)[0], np.eye(64)[1]
    centres = [base, 0.985 * base + np.sqrt(1 - 0.985**2) * other]
    rows = [(12 * c + i, (centre + 0.004 * random.standard_normal(64)).tolist(), 0) for c, centre in enumerate(centres) for i in range(12)]
    rows += [(100 + i, random.standard_normal(64).tolist(), i % 2) for i in range(40)]
    x = np.array([v for _, v, _ in rows])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = (x @ x.T >= 0.98) & (np.array([k for *_, k in rows])[:, None] == np.array([k for *_, k in rows])) & ~np.eye(len(rows), dtype=bool)
    assert near[:12, 12:24].any()
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), enough=enough).collect()}
    assert got == {i: (int(n), 0 if i < 24 else i) for (i, *_), n in zip(rows, near.sum(axis=1))}


def test_templates(spark):
    urls = [f"http://a.example.net/{lang}/{i}" for lang in ("es", "fr", "de") for i in range(20)] + [None, "no scheme", "HTTP://WWW.Example.COM/en/1#x"]
    got = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    verdicts = {r.page_id: (r.host, r.rule, r.verdict) for r in got}
    assert verdicts[0] == ("a.example.net", "net/es/", "block") and verdicts[45][2] == "allow" and verdicts[60] == ("", None, "allow") and verdicts[62] == ("www.example.com", "www.example.com/en/", "allow")


def test_pairs(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "<|end|>"), (0, 2, "user", "more"), (0, 3, "assistant", "last"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "alone"), (None, 0, "user", "x"), (4, 0, "assistant", "same"), (5, 0, "assistant", "same"), (5, 1, "user", "on")]
    held = preference.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.pair_id: r for r in preference.format_pairs(preference.pair_up(held)).collect()}
    assert {i: r.shared_turns for i, r in got.items()} == {0: 3, 1: 2, 4: 1, 5: 0}
    assert got[0].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\n<|\u200bend|><|end|>\n<|user|>\nmore<|end|>\n"
    assert (got[0].chosen, got[0].rejected) == ("<|assistant|>\nlast<|end|>\n", "<|assistant|>\n<|end|>\n")
    for side in ("chosen", "rejected"):
        (span,), text = got[0][f"{side}_mask"], got[0].prompt + got[0][side]
        assert text[span.start : span.end] == ("last" if side == "chosen" else "") + "<|end|>\n"
    assert got[4].chosen == got[4].rejected == "" and got[5].rejected == "<|assistant|>\n<|end|>\n<|user|>\non<|end|>\n"
