"""The queries opN_<name> and the DuckDB SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bwt_dedup, ctw, mixing, ngram_join, nn_descent, preference, quality_rules, toxicity, url_templates
from .common import read


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).drop("host_rate")


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digest(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read(spark, sf_dir, "documents"))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.digest(read(spark, sf_dir, "conversations"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read(spark, sf_dir, "documents"))


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read(spark, sf_dir, "documents"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], chr(1)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 7)),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM j GROUP BY source),
p AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS v FROM h),
k AS (SELECT m, least(greatest(coalesce(m * (1 - m) / nullif(v, 0) - 1, 1000), 2), 1000) AS k FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND (f + m * k) / (n + k) <= 0.5 AS kept
FROM j JOIN h ON j.source IS NOT DISTINCT FROM h.source, k
"""


def _permute(x: str, keys: str, n: str) -> str:
    return (
        f"list_reduce({keys}, lambda a, s: struct_pack(x := CASE WHEN md5(concat(s.t, ':', greatest(a.x, (s.x - a.x + {n}) % {n})))[1] < '8'"
        f" THEN (s.x - a.x + {n}) % {n} ELSE a.x END, t := ''), struct_pack(x := ({x})::BIGINT, t := '')).x"
    )


def _keys(tag: str, n: str) -> str:
    return f"list_transform(range(1, {mixing.ROUNDS + 1}), lambda r: struct_pack(x := ('0x' || md5(concat({tag}, ':', r))[1:12])::BIGINT % greatest({n}, 1)::BIGINT, t := concat({tag}, ':', r)))"


OP6 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk, 3 * source_size AS cap FROM s),
w AS (SELECT *, (rk - 1) % 3 + 1 AS weight FROM r),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE AS words, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS weights
  FROM w WINDOW b AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
lam AS (SELECT words / weights AS lam FROM l WHERE cap / weight >= words / weights ORDER BY cap / weight, rk LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN cap / weight >= words / weights THEN weight * (SELECT lam FROM lam) ELSE cap::DOUBLE END AS target FROM l
),
p AS (
  SELECT *, least(round(target)::BIGINT, 3 * source_size) // source_size AS passes, least(round(target)::BIGINT, 3 * source_size) % source_size AS part,
    source_size // 512 AS whole, (source_size + 511) // 512 AS blocks, source_size % 512 AS rest, concat('0', coalesce(concat(':s', source), ':n')) AS tag
  FROM t WHERE source_size > 0
),
m AS (SELECT *, coalesce(sum(n) OVER (ORDER BY encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low, sum(n) OVER ()::BIGINT AS every
  FROM (SELECT *, (passes * blocks + (part + 511) // 512)::BIGINT AS n, {_keys('tag', 'whole')} AS keys FROM p) WHERE n > 0),
v AS (SELECT place, ('0x' || md5(concat('0:draw:', place))[1:12])::BIGINT % every AS v FROM (SELECT unnest(range((SELECT max(every) FROM m))) AS place), (SELECT max(every) AS every FROM m)),
g AS (SELECT place, low, row_number() OVER (PARTITION BY low ORDER BY place) - 1 AS i FROM v ASOF JOIN m ON v.v >= m.low),
c AS (SELECT m.low, n, count(place) AS drawn FROM m LEFT JOIN g ON m.low = g.low GROUP BY ALL),
x AS (
  SELECT *, coalesce(sum(greatest(drawn - n, 0)) OVER b, 0)::BIGINT AS over_low, coalesce(sum(greatest(n - drawn, 0)) OVER b, 0)::BIGINT AS under_low FROM c
  WINDOW b AS (ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
y AS (
  SELECT place, g.low, i AS slot FROM g JOIN x ON g.low = x.low WHERE i < n
  UNION ALL
  SELECT place, u.low, u.drawn + r - u.under_low FROM (SELECT place, over_low + i - n AS r FROM g JOIN x ON g.low = x.low WHERE i >= n) ASOF JOIN (SELECT * FROM x WHERE n > drawn) u ON r >= u.under_low
),
b AS (SELECT m.*, slot // blocks AS epoch, slot % blocks AS q FROM y JOIN m ON y.low = m.low),
e AS (
  SELECT source, CASE WHEN q >= whole THEN whole ELSE {_permute('q', 'keys', 'whole')} END AS block,
    CASE WHEN epoch = passes AND (q + 1) * 512 > part THEN part - q * 512 WHEN q >= whole THEN rest ELSE 512 END AS take
  FROM b
),
o AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id % {mixing.RUNS}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d
),
n AS (
  SELECT doc_id, sum(greatest(0, least(block * 512 + take, first + size) - greatest(block * 512, first))) AS taken
  FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source AND block BETWEEN first // 512 AND (first + size - 1) // 512 WHERE size > 0 GROUP BY doc_id
)
SELECT d.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON d.doc_id = n.doc_id
"""


LOWERED = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOWERED} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM d
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS node FROM n UNION SELECT r.doc_id, y FROM r JOIN e ON node = x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.k, 0)::BIGINT AS n_similar, coalesce(m.m, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, count(*) AS k FROM e GROUP BY x) k ON d.doc_id = x LEFT JOIN (SELECT doc_id, min(node) AS m FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS node FROM v UNION SELECT r.vec_id, y FROM r JOIN e ON node = x),
m AS (SELECT vec_id, min(node) AS m FROM r GROUP BY vec_id)
SELECT t.vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(m, t.vec_id) AS component_id, t.vec_id = coalesce(m, t.vec_id) AS kept
FROM embeddings t LEFT JOIN m ON t.vec_id = m.vec_id LEFT JOIN (SELECT x, count(*) AS k FROM e GROUP BY x) c ON t.vec_id = c.x
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_ngram_join": OP8, "op10_nn_descent": OP10, "op1_url_templates": url_templates.oracle(), "op7_preference": preference.ORACLE, "op4_quality_rules": OP4, "op6_mixing": OP6}
