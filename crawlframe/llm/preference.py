"""Chat formatting for preference data.

A pair of conversations, chosen and rejected, shares a prefix of turns. The longest common prefix (equal
role and text) is rendered once as the prompt; what follows in each is its completion. Both completions
carry masks: spans of characters, in prompt + completion, that are trained on (the assistant's texts).

Rendering: each turn is `<|role|>\\n`, its text, `<|end|>\\n`. Special strings inside a text are broken up by
a zero-width space after their first two characters, so that no text can forge a turn.

Edge cases: turns are ordered by (turn, role, text), nulls first; null roles and texts render as empty; turns
repeated in full are kept once; conversations without assistant turn give no pair, and both completions of equal
conversations are empty; turns without conversation id are left out; very long texts are rendered whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (role, text). A conversation's own turns bound the array."""
    each = turns.filter("conv_id IS NOT NULL").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    return each.groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list("t"))).alias("t")).selectExpr(
        "conv_id", "transform(t, x -> struct(coalesce(x.role, '') AS role, coalesce(x.text, '') AS text)) AS turns"
    )


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.regexp_replace(t["role"], "[<|>]", ""), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.regexp_replace(t["text"], r"<\|", "<|​")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("<|end|>\n"))), "")


def mask(turns: Column, offset: Column) -> Column:
    """Spans [start, end) of the assistant's texts with their end marks, in characters from `offset` on."""
    zero = F.struct(offset.cast("long").alias("at"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_body(t)) + len("<|end|>\n")
        own = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen and rejected (arrays of role and text). Adds prompt, both completions and masks."""
    both = F.least(F.size("chosen"), F.size("rejected"))
    index = F.when(both > 0, F.sequence(F.lit(1), both)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(index, lambda i: F.element_at("chosen", i) != F.element_at("rejected", i))
    shared = F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, both)
    out = pairs.withColumn("shared", shared)
    part = lambda c, start, n: F.slice(c, start, n)
    out = out.withColumn("prompt", render(part("chosen", F.lit(1), F.col("shared"))))
    for name in ("chosen", "rejected"):
        rest = part(name, F.col("shared") + 1, F.greatest(F.size(name) - F.col("shared"), F.lit(0)))
        out = out.withColumn(f"{name}_rest", rest)
    return out.select(
        "pair_id", F.col("shared").cast("int").alias("shared_turns"), "prompt",
        render(F.col("chosen_rest")).alias("chosen"), mask(F.col("chosen_rest"), F.length("prompt")).alias("chosen_mask"),
        render(F.col("rejected_rest")).alias("rejected"), mask(F.col("rejected_rest"), F.length("prompt")).alias("rejected_mask"),
    )


def pair_up(held: DataFrame) -> DataFrame:
    """Pairs from conversations: chosen as it is; rejected with its last assistant turn's text replaced by that of the conversation with the next id, or emptied where there is none.

    pair_id is the conversation's id; conversations without assistant turn give no pair.
    """
    at = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), "assistant") + 1
    own = held.withColumn("at", at.cast("int")).filter(F.array_contains(F.transform("turns", lambda t: t["role"]), "assistant"))
    other = own.select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", F.col("at"))["text"].alias("other"))
    met = own.join(other, "conv_id", "left")
    turn = F.struct(F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    rejected = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("at"), turn).otherwise(t))
    return met.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def digest(turns: DataFrame) -> DataFrame:
    """The formatted pairs of a table of turns, the masks as text: start-end, separated by commas."""
    out = format_pairs(pair_up(conversations(turns)))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("chosen_mask", text("chosen_mask")).withColumn("rejected_mask", text("rejected_mask"))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role AS r, text AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, coalesce(r, '') AS role, coalesce(x, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) AS i FROM t),
a AS (SELECT conv_id, max(i) AS last FROM c WHERE role = 'assistant' GROUP BY conv_id),
o AS (SELECT c.conv_id - 1 AS conv_id, text AS other FROM c JOIN a ON c.conv_id = a.conv_id AND i = last),
n AS (
  SELECT c.conv_id AS pair_id, 0 AS side, role, text, i FROM c JOIN a USING (conv_id)
  UNION ALL
  SELECT c.conv_id, 1, role, CASE WHEN i = last THEN coalesce(other, '') ELSE text END, i FROM c JOIN a USING (conv_id) LEFT JOIN o USING (conv_id)
),
l AS (SELECT pair_id, max(i) FILTER (WHERE side = 0) AS a, max(i) FILTER (WHERE side = 1) AS b FROM n GROUP BY pair_id HAVING a IS NOT NULL AND b IS NOT NULL),
d AS (SELECT pair_id, i FROM n JOIN l USING (pair_id) WHERE i <= least(a, b) GROUP BY pair_id, i HAVING count(DISTINCT (role, text)) > 1),
s AS (SELECT l.pair_id, coalesce(min(d.i) - 1, any_value(least(a, b))) AS shared FROM l LEFT JOIN d USING (pair_id) GROUP BY l.pair_id),
m AS (
  SELECT n.*, shared, concat('<|', regexp_replace(role, '[<|>]', '', 'g'), '|>', chr(10)) AS head, concat(replace(text, '<|', '<|' || chr(8203)), '<|end|>', chr(10)) AS body,
  FROM n JOIN s USING (pair_id)
),
w AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side ORDER BY i) AS till FROM m
),
z AS (
  SELECT pair_id, any_value(shared) AS shared, coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= shared), '') AS prompt,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 0 AND i > shared), '') AS chosen,
    coalesce(string_agg(concat(till - length(body), '-', till), ',' ORDER BY i) FILTER (WHERE side = 0 AND i > shared AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 1 AND i > shared), '') AS rejected,
    coalesce(string_agg(concat(till - length(body), '-', till), ',' ORDER BY i) FILTER (WHERE side = 1 AND i > shared AND role = 'assistant'), '') AS rejected_mask
  FROM w GROUP BY pair_id
)
SELECT pair_id, shared::INTEGER AS shared_turns, prompt, chosen, chosen_mask, rejected, rejected_mask FROM z
"""
