"""Preference pairs as prompt and masked completions.

For each pair the longest common prefix of turns of the chosen and the rejected conversation is
rendered once as the prompt; what follows on either side is its completion, with the character ranges
that count in the loss. DataFrame functions only: one grouping by pair, then array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role CLOSE newline text END newline.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END + "\n"))), "")


def _spans(turns: Column, trained_roles: list[str]) -> Column:
    """[start, end) in characters of the rendered turns: text and end marker of the trained roles."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"].isin(trained_roles), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, add)["spans"]


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per pair: n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``side_col`` is 'chosen' or 'rejected'; rows with another side or a null pair are left out. Null role
    or text counts as empty. Turns are ordered by number (null first), then role, then text, so rows
    repeated or tied have one order. A missing side is an empty conversation, and then the prompt is
    empty. Equal conversations are all prompt. Other columns are ignored.
    A pair is one row, so its turns meet in one task, in memory proportional to them.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col(side_col) == name, turn)))
    rows = turns.where(F.col(pair_col).isNotNull() & F.col(side_col).isin("chosen", "rejected"))
    both = rows.groupBy(F.col(pair_col).alias("pair_id")).agg(side("chosen").alias("c"), side("rejected").alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), shorter), F.slice("r", F.lit(1), shorter), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, False)
    both = both.withColumn("n", F.when(first > 0, (first - 1).cast("int")).otherwise(shorter))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    both = both.withColumn("ct", rest("c")).withColumn("rt", rest("r"))
    return both.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(F.col("ct")).alias("chosen"),
        _rendered(F.col("rt")).alias("rejected"),
        _spans(F.col("ct"), list(trained_roles)).alias("chosen_spans"),
        _spans(F.col("rt"), list(trained_roles)).alias("rejected_spans"),
    )


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of conversations 2k (chosen) and 2k + 1 (rejected) as pair k; null ids are left out."""
    rows = conversations.where(F.col("conv_id").isNotNull())
    odd = F.pmod(F.col("conv_id").cast("long"), F.lit(2))
    side = F.when(odd == 0, "chosen").otherwise("rejected")
    # Whole numbers all along: a quotient of doubles would round ids from 2**53 on.
    return rows.withColumn("_odd", odd).select(F.expr("(cast(conv_id as bigint) - _odd) div 2").alias("pair_id"), side.alias("side"), "turn", "role", "text")


def mask_text(spans: Column) -> Column:
    """Spans as 'start-end' joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


ORACLE = """
WITH t AS (
  SELECT (conv_id - abs(conv_id % 2)) // 2 AS pair_id, abs(conv_id % 2) AS side, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT c.pair_id, c.i, c.role = r.role AND c.txt = r.txt AS eq
  FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.i = r.i AND c.side = 0 AND r.side = 1),
p AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT eq), count(*)) AS n FROM e GROUP BY pair_id),
x AS (SELECT t.*, coalesce(p.n, 0) AS n, '<|' || role || '|>' || chr(10) AS head,
    '<|' || role || '|>' || chr(10) || txt || '<|end|>' || chr(10) AS shown
  FROM t LEFT JOIN p ON t.pair_id = p.pair_id),
y AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, i >= n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
z AS (SELECT *, CAST(before + length(head) AS BIGINT)::VARCHAR || '-' || CAST(before + length(shown) - 1 AS BIGINT)::VARCHAR AS span FROM y)
SELECT pair_id, max(n) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i < n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i >= n), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 1 AND i >= n), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 0 AND i >= n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 1 AND i >= n AND role = 'assistant'), '') AS rejected_mask
FROM z GROUP BY pair_id
"""
