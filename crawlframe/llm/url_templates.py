"""URL filters: explicit rules first, then a tree of path templates learnt for each host.

Paths are cut into segments, in which runs of digits become `*`. Level by level, a node's children with
fewer than LEAST_COUNT urls become one wildcard `*`; of the others, whatever their share, those whose labels do not
differ from their labelled siblings' (two-proportion z-test) are merged into one branch `{*}`, and the rest stay
apart. Every path thus falls under one template. Levels go on to the last segment; below a node with fewer than LEAST_COUNT urls
all segments are wildcards, so that a few deep paths take no rounds of their own.
A template is rejected if the share of its allowed labels, smoothed by a beta prior of mean
`prior` and `strength` labels' weight, is below `least`; templates without labels keep the prior.

The labels are the verdicts of the rules on the urls that a rule fits.

Edge cases: a null url, and one without `://`, has an empty host and path, and is judged by its (empty)
template like any other; very long urls are read whole, to any depth; children with equal counts are treated alike, so ties
need no order; repeated rows count each; a null page_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: (rule, verdict): a host, and a path from the first slash on.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_COUNT, LEAST_LABELS, Z = 5, 5, 1.96
PRIOR, STRENGTH, LEAST = 0.7, 4, 0.5
#: SQL that Spark and DuckDB share: the child's labels against its siblings'.
SIMILAR = (
    f"c.good + c.bad >= {LEAST_LABELS} AND p.good + p.bad - c.good - c.bad >= {LEAST_LABELS} AND"
    f" abs(c.good / cast(c.good + c.bad AS double) - (p.good - c.good) / cast(p.good + p.bad - c.good - c.bad AS double))"
    f" <= {Z} * sqrt(cast(p.good AS double) / (p.good + p.bad) * p.bad / (p.good + p.bad) * (1.0 / (c.good + c.bad) + 1.0 / (p.good + p.bad - c.good - c.bad)))"
)


def rule_case(column: str, rules: list[tuple[str, str]] = RULES) -> str:
    """SQL for the longest rule that fits host and path; column: 0 for the rule, 1 for its verdict."""
    cases = ""
    for rule in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, path = rule[0].partition("/")
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        cases += f" WHEN (host = {quote(host)} OR endswith(host, {quote('.' + host)})) AND startswith(path, {quote(slash + path)}) THEN {quote(rule[int(column)])}"
    return f"CASE{cases} END"


def parsed(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict) and segments of each row."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    out = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).selectExpr(
        "page_id", f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host", "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"
    )
    out = out.selectExpr("*", f"{rule_case('0', rules)} AS rule", f"{rule_case('1', rules)} AS ruled", "filter(split(regexp_replace(path, '[0-9]+', '*'), '/'), x -> x <> '') AS segments")
    return out.select("page_id", "host", "path", "rule", "ruled", "segments")


def templates(urls: DataFrame, salt: int = 16) -> DataFrame:
    """For each (host, shape) of parsed urls: its template and the template's labels (good, bad) and purity. shape: the segments, joined."""
    known = urls.selectExpr("host", "segments", "array_join(segments, '/') AS shape", "cast(ruled = 'allow' AS bigint) AS good", "cast(ruled = 'block' AS bigint) AS bad")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    tree = settle(known.groupBy("host", "shape", "segments").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumn("template", F.lit("")), "shapes")
    level, done, open_ = 0, [tree.filter("size(segments) = 0")], tree.filter("size(segments) > 0")
    while open_.limit(1).count():
        level += 1
        here = open_.withColumn("seg", F.element_at("segments", level))
        children = here.groupBy("host", "template", "seg").agg(*sums).withColumn("_t", F.pmod(F.xxhash64("seg"), F.lit(salt)).cast("int"))
        # A hot host's children meet their node in `salt` tasks.
        nodes = children.groupBy("host", "template").agg(*sums).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        c, p = children.alias("c"), nodes.alias("p")
        step = f"CASE WHEN c.n < {LEAST_COUNT} THEN '/*' WHEN coalesce({SIMILAR}, false) THEN '/{{*}}' ELSE concat('/', seg) END AS step"
        steps = c.join(p, ["host", "template", "_t"]).selectExpr("host", "template", "seg", step, f"p.n < {LEAST_COUNT} AS few")
        met = here.join(steps, ["host", "template", "seg"])
        path = F.when(F.col("few"), F.expr(f"repeat('/*', size(segments) - {level - 1})")).otherwise(F.col("step"))
        met = met.withColumn("template", F.concat("template", path)).withColumn("done", F.col("few") | (F.size("segments") == level))
        met = settle(met.select(*tree.columns, "done"), "tree")
        done.append(met.filter("done").drop("done"))
        open_ = met.filter("NOT done").drop("done")
    tree = reduce(DataFrame.unionByName, done)
    purity = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    purity = purity.withColumn("purity", F.expr(f"(good + cast({PRIOR * STRENGTH} AS double)) / (good + bad + {STRENGTH})"))
    # A hot template's shapes meet its purity in `salt` tasks.
    purity = purity.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    shapes = tree.select("host", "shape", "template", F.pmod(F.xxhash64("shape"), F.lit(salt)).cast("int").alias("_t"))
    return shapes.join(purity, ["host", "template", "_t"]).drop("_t")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, salt: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row of pages."""
    urls = parsed(pages, rules)
    found = templates(urls).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    urls = urls.withColumn("shape", F.array_join("segments", "/")).withColumn("_t", F.coalesce(F.pmod("page_id", F.lit(salt)), F.lit(0)).cast("int"))
    # A hot template's urls are spread over `salt` keys.
    met = urls.join(found, ["host", "shape", "_t"], "left")
    return met.selectExpr("page_id", "host", "path", "rule", f"coalesce(ruled, CASE WHEN purity < {LEAST} THEN 'block' ELSE 'allow' END) AS verdict", "template", "purity")


def oracle() -> str:
    """The same in DuckDB's SQL, for op1's table."""
    duck = lambda sql: sql.replace("startswith", "starts_with").replace("endswith", "ends_with")
    similar = SIMILAR.replace("c.good", "cg").replace("c.bad", "cb").replace("p.good", "pg").replace("p.bad", "pb")
    return rf"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM r)),
u AS (
  SELECT *, {duck(rule_case('0'))} AS rule, {duck(rule_case('1'))} AS ruled, list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda x: x <> '') AS segments
  FROM h
),
s AS (SELECT *, array_to_string(segments, '/') AS shape FROM u),
t AS (
  SELECT host, shape, segments, count(*) AS n, count(*) FILTER (WHERE ruled = 'allow') AS good, count(*) FILTER (WHERE ruled = 'block') AS bad, '' AS template, 0 AS k FROM s GROUP BY host, shape, segments
  UNION ALL
  SELECT host, shape, segments, n, good, bad, concat(template, CASE WHEN cn < {LEAST_COUNT} THEN '/*' WHEN cg + cb > 0 AND pg + pb > cg + cb AND {similar} THEN '/{{*}}' ELSE '/' || segments[k + 1] END), k + 1
  FROM (
    SELECT *, sum(n) OVER c AS cn, sum(good) OVER c AS cg, sum(bad) OVER c AS cb, sum(good) OVER p AS pg, sum(bad) OVER p AS pb FROM t WHERE len(segments) > k
    WINDOW c AS (PARTITION BY host, template, segments[k + 1]), p AS (PARTITION BY host, template)
  )
),
f AS (SELECT * FROM t WHERE k = len(segments)),
q AS (SELECT host, template, (sum(good) + cast({PRIOR * STRENGTH} AS double)) / (sum(good) + sum(bad) + {STRENGTH}) AS purity FROM f GROUP BY ALL)
SELECT page_id, s.host, path, rule, coalesce(ruled, CASE WHEN purity < {LEAST} THEN 'block' ELSE 'allow' END) AS verdict, q.template, purity
FROM s JOIN f ON s.host = f.host AND s.shape = f.shape JOIN q ON f.host = q.host AND f.template = q.template
"""
