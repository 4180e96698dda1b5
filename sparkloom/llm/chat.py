"""Multi-party perspective rotation of conversations.

For every participant a conversation is rendered once, that speaker as the assistant and all others as named users;
the loss mask covers the assistant's words and end tags alone. One shuffle gathers a conversation's turns; rotation
happens in its row. A dialogue, being one training example, has to fit a row.

Defined results: turns are ordered by (turn, role, text), nulls first; null role is the speaker ``unknown``; null or
empty text is an empty turn; repeated turns stay; rows with a null conv_id make up a conversation of their own; an empty table
gives no rows. ``<|`` in a text is written ``< |``, so that texts can't forge tags. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, rendered, mask_spans (``start-end`` in characters, comma-separated), mask_chars."""
    turns = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    each = whole.select("conv_id", "turns", F.explode(F.expr("array_distinct(transform(turns, t -> t.role))")).alias("perspective"))
    tag = "if(t.role = perspective, '<|assistant|>', '<|user name=' || t.role || '|>')"
    each = each.withColumn("parts", F.expr(f"transform(turns, t -> struct(t.role = perspective AS own, {tag} || '\n' AS head, t.text || '<|end|>' AS body))"))
    spans = """aggregate(parts, struct(0L AS at, cast(array() AS array<struct<a: bigint, b: bigint>>) AS spans), (acc, p) -> struct(
        acc.at + length(p.head) + length(p.body) + 1 AS at,
        if(p.own, array_append(acc.spans, struct(acc.at + length(p.head) AS a, acc.at + length(p.head) + length(p.body) AS b)), acc.spans) AS spans)).spans"""
    each = each.withColumn("spans", F.expr(spans))
    return each.select(
        "conv_id",
        "perspective",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(parts, p -> p.head || p.body || '\n'), '')").alias("rendered"),
        F.expr("array_join(transform(spans, s -> s.a || '-' || s.b), ',')").alias("mask_spans"),
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)").alias("mask_chars"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |')) AS i
  FROM conversations),
v AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
p AS (
  SELECT t.conv_id, v.perspective, i, t.role = v.perspective AS own,
    CASE WHEN t.role = v.perspective THEN '<|assistant|>' ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head, text || '<|end|>' AS body
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
s AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM p)
SELECT conv_id, perspective, count(*)::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY i) AS rendered,
  string_agg(CASE WHEN own THEN (pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR END, ',' ORDER BY i) AS mask_spans,
  sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS mask_chars
FROM s GROUP BY conv_id, perspective
"""
