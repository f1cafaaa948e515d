"""Operator 10: preference pairs with a shared prompt and masked completions (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

EMPTY = "array<struct<turn:bigint,role:string,text:string>>"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _spans(turns: Column, trained_role: str) -> Column:
    """Where a rendered completion is trained on: ``start:end`` of each text of ``trained_role``, in characters."""
    head = lambda t: F.length(t["role"]) + 5  # noqa: E731  <|role|> and a line end
    size = lambda t: head(t) + F.length(t["text"]) + 8  # noqa: E731  <|end|> and a line end

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + head(t)
        span = F.concat(start.cast("string"), F.lit(":"), (start + F.length(t["text"])).cast("string"))
        spans = F.when(t["role"] == trained_role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + size(t)).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def format_preferences(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row for each pair of ``turns(pair_id, side, turn, role, text)``, side being ``chosen`` or ``rejected``.

    The longest common prefix of turns (same role and text, in order of turn, role, text) is rendered once as
    ``prompt``; what follows it on either side is rendered as ``chosen`` and ``rejected``. ``*_mask`` lists the
    character spans of a completion that are trained on: texts of ``trained_role``, not headers or other turns.

    Null role or text counts as empty, a null turn comes first, repeated rows count once, and several texts with one
    turn number are ordered by role and text. Rows with null pair_id or another side are left out. A pair of which one
    side is missing stays, with ``both`` false, an empty prompt and an empty completion on that side. Two equal sides
    give a prompt and two empty completions. Other columns are ignored; an empty table gives an empty result. The turns
    of one pair meet in one row, so a pair must fit in a string, as its rendering must anyway.
    """
    t = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda s: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("side") == s, t)))).cast(EMPTY)
    got = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    got = got.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    got = got.withColumn("n", F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int"))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x), F.lit(1)))
    return got.select(
        "pair_id", ((F.size("c") > 0) & (F.size("r") > 0)).alias("both"), F.col("n").alias("prompt_turns"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("c")).alias("chosen"), _spans(rest("c"), trained_role).alias("chosen_mask"),
        _render(rest("r")).alias("rejected"), _spans(rest("r"), trained_role).alias("rejected_mask"),
    )


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` names no pairs: conversation 2k is taken as chosen, 2k + 1 as rejected, of pair k."""
    turns = table(spark, sf_dir, "conversations")
    return format_preferences(turns.select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text",
    ))


OP10_SQL = r"""
WITH d AS (
  SELECT DISTINCT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
sizes AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id),
bad AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.i, r.i)) AS first
  FROM (SELECT * FROM t WHERE side = 0) c FULL JOIN (SELECT * FROM t WHERE side = 1) r ON c.pair_id = r.pair_id AND c.i = r.i
  WHERE c.i IS NULL OR r.i IS NULL OR c.role <> r.role OR c.text <> r.text GROUP BY 1),
n AS (SELECT s.*, coalesce(first - 1, nc) AS n FROM sizes s LEFT JOIN bad USING (pair_id)),
x AS (
  SELECT t.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length(role) + 5 AS head FROM t JOIN n USING (pair_id)),
y AS (
  SELECT *, coalesce(sum(CASE WHEN i > n THEN length(shown) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off_ FROM x),
z AS (
  SELECT pair_id,
    string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= n) AS prompt,
    string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > n) AS chosen,
    string_agg(CAST(CAST(off_ + head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(off_ + head + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (side = 0 AND i > n AND role = 'assistant') AS chosen_mask,
    string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > n) AS rejected,
    string_agg(CAST(CAST(off_ + head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(off_ + head + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (side = 1 AND i > n AND role = 'assistant') AS rejected_mask
  FROM y GROUP BY pair_id)
SELECT n.pair_id, nc > 0 AND nr > 0 AS both, CAST(n AS INTEGER) AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
  coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected, '') AS rejected, coalesce(rejected_mask, '') AS rejected_mask
FROM n JOIN z USING (pair_id)
"""
