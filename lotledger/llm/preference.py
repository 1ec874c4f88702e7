"""Preference formatting: one prompt, two masked completions.

A preference pair is two conversations, chosen and rejected. The longest common
prefix of their turns (equal role and equal text, null equal to null) is rendered
once as the prompt; what each conversation has beyond it is rendered as its
completion. In a completion, loss is taken on the text and closing mark of
assistant turns only; ``mask`` holds those spans as start:end (code points,
end exclusive), joined by commas.

Input: one row a turn, with the pair, the side (``chosen`` or ``rejected``), a
turn number, role and text. Turns stand in order of number, then role, then
text; rows that tie in all three are equal, so their order is immaterial, and
each stays a turn of its own.

The common prefix takes no collection of turns: turns get their place by a window
over one side of one pair, the sides meet in an equality join on (pair, place),
and the first place where they differ is an aggregate. Sides that open alike in
very many pairs are never joined with each other, only within their own pair.

Defined results: a pair with one side missing has that side's completion null and
an empty prefix; a pair without any assistant turn past the prefix has an empty
mask; null role and text render as empty; a side that is a prefix of the other
has an empty completion; an empty table gives an empty result; further columns of
the input are left out (a result row stands for a pair).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

# Fixed values of the rendering.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def render(role: Column, text: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(OPEN), blank(role), F.lit(AFTER_ROLE), blank(text), F.lit(CLOSE))


def format_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask)."""
    t = turns.select(
        F.col(pair).alias("pair"), F.col(side).alias("side"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    ).filter(F.col("side").isin("chosen", "rejected"))
    t = t.withColumn("place", F.row_number().over(Win.partitionBy("pair", "side").orderBy("turn", "role", "text")))
    # Both sides of a place in one row; a place with one side, or with unlike turns, ends the prefix.
    # The turns travel as hashes; the texts stay in t.
    key = F.struct("place", F.coalesce("role", F.lit("\0")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    code = F.sha2(F.to_json(key), 256)
    at = t.groupBy("pair", "place").agg(
        F.min(code).alias("low"), F.max(code).alias("high"), F.count("*").alias("n")
    )
    unlike = F.when((F.col("n") < 2) | (F.col("low") != F.col("high")), F.col("place"))
    prefix = at.groupBy("pair").agg(
        (F.coalesce(F.min(unlike), F.max("place") + 1) - 1).alias("n_prompt_turns")
    )
    t = t.join(prefix.withColumnRenamed("pair", "p"), F.col("pair").eqNullSafe(F.col("p")))
    piece = F.struct("place", render(F.col("role"), F.col("text")).alias("piece"), F.length(F.coalesce("role", F.lit(""))).alias("head"),
                     (F.coalesce(F.col("role"), F.lit("")) == "assistant").alias("trained"))
    after = F.col("place") > F.col("n_prompt_turns")
    sides = t.groupBy("pair", "side", "n_prompt_turns").agg(
        F.array_sort(F.collect_list(F.when(~after, piece))).alias("before"), F.array_sort(F.collect_list(F.when(after, piece))).alias("rest")
    )
    sides = sides.select(
        "pair", "side", "n_prompt_turns", F.array_join("before.piece", "").alias("prompt"), F.array_join("rest.piece", "").alias("completion"),
        _mask(F.col("rest")).alias("mask"),
    )
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return sides.groupBy("pair").agg(
        F.max("n_prompt_turns").cast("long").alias("n_prompt_turns"), F.max("prompt").alias("prompt"),
        *(pick(s, c).alias(s + tail) for s in ("chosen", "rejected") for c, tail in (("completion", ""), ("mask", "_mask"))),
    ).withColumnRenamed("pair", pair)


def _mask(rest: Column) -> Column:
    """Spans of text and closing mark of trained turns, by the running length of the pieces."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, x):
        end = acc["at"] + F.length(x["piece"])
        begin = acc["at"] + F.lit(len(OPEN) + len(AFTER_ROLE)) + x["head"]
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(x["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(rest, start, step, lambda acc: F.array_join(acc["spans"], ","))


def reply_swaps(conversations: DataFrame, whole: bool = False) -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation as it stands; in rejected its
    last assistant turn holds the last reply of the neighbouring conversation (conv_id 2k and
    2k + 1). Conversations without an assistant turn, or without such a neighbour, give none.
    Turns after the last reply are left out on both sides.

    With ``whole`` every conversation (a null conv_id is one of them) gives its chosen side, and
    turns after the last reply stay on both sides. Where there is nothing to swap, as above, the
    rejected side is missing, so that ``format_pairs`` has its completion null."""
    c = conversations.select("conv_id", "turn", "role", "text")
    last = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    last = last.select("conv_id", F.col("m.turn").alias("last_turn"), F.col("m.text").alias("reply"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("other"))
    ends = last.select("conv_id", "last_turn").join(other, "conv_id")
    t = c.join(ends, "conv_id")
    if not whole:
        t = t.filter("turn <= last_turn")
    chosen = (c if whole else t).select("conv_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    at_last = F.col("turn").eqNullSafe(F.col("last_turn")) & (F.col("role") == "assistant")
    swapped = F.when(at_last, F.col("other")).otherwise(F.col("text"))
    return chosen.unionByName(t.select("conv_id", F.lit("rejected").alias("side"), "turn", "role", swapped.alias("text")))
