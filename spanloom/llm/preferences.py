"""Preference formatting of chat turns, in DataFrame functions only.

A pair's prompt is the longest common turn prefix of its chosen and rejected conversations, rendered
once; the two completions are what follows. Each completion comes with its mask: the character
ranges (start, end) on which a loss is taken, which are the assistant's texts and their closing
marks. Turns of other roles, and all headers, are masked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id_col, turns): each conversation's turns in order; equal turn numbers go by role and text.

    Null roles and texts become empty ones; rows that repeat stay; a null id is a conversation of its own.
    """
    turn = F.struct(turns[turn_col].alias("at"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"))
    grouped = turns.select(turns[id_col].alias("id"), turn.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select(F.col("id").alias(id_col), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END))), "")


def mask(turns: Column, trained_role: str = "assistant") -> Column:
    """Ranges (start, end) of characters of render(turns) that are trained on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("ranges"))

    def step(acc: Column, t: Column) -> Column:
        opens = acc["at"] + F.length(head(t["role"]))
        ends = opens + F.length(t["text"]) + len(END)
        here = F.when(t["role"] == trained_role, F.array(F.struct(opens.alias("start"), ends.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(ends.alias("at"), F.concat(acc["ranges"], here).alias("ranges"))

    return F.aggregate(turns, start, step, lambda acc: acc["ranges"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs of turn arrays (role, text) with prompt_turns, prompt, both completions and both masks.

    Replaces the two arrays by completions of the same names. A missing (null) side leaves the prompt
    empty and its completion and mask null; equal conversations leave both completions empty.
    """
    both = F.least(F.size(chosen), F.size(rejected))
    differs = F.filter(F.sequence(F.lit(0), both), lambda i: (i == both) | (F.get(chosen, i) != F.get(rejected, i)))
    prefix = F.when(F.col(chosen).isNull() | F.col(rejected).isNull(), 0).otherwise(differs[0])
    out = pairs.withColumn("prompt_turns", prefix)
    out = out.withColumn("prompt", F.when(F.col("prompt_turns") == 0, F.lit("")).otherwise(render(F.slice(chosen, F.lit(1), F.col("prompt_turns")))))
    for side in (chosen, rejected):
        out = out.withColumn(side, F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.size(side) - F.col("prompt_turns"), F.lit(0))))
        out = out.withColumn(f"{side}_mask", mask(F.col(side))).withColumn(side, render(F.col(side)))
    return out


def mask_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")


def spliced_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A pair for each conversation: itself, and its own first turns followed by its partner's later ones.

    2i and 2i + 1 are partners. Of n turns, i mod (n + 1) are kept, so the two may part anywhere, one
    may be the start of the other, and both may be equal. Without a partner, or for a null id, the
    rejected side is null.
    """
    own = conversations(turns, id_col)
    other = own.select((F.col(id_col).bitwiseXOR(F.lit(1))).alias("_partner"), F.col("turns").alias("_other"))
    joined = own.join(other, own[id_col] == other["_partner"], "left")
    kept = F.pmod(F.floor(F.col(id_col) / 2), F.size("turns") + 1).cast("int")
    rest = F.slice("_other", kept + 1, F.greatest(F.size("_other") - kept, F.lit(0)))
    rejected = F.when(F.col("_other").isNotNull(), F.concat(F.slice("turns", F.lit(1), kept), rest))
    return joined.select(id_col, F.col("turns").alias("chosen"), rejected.alias("rejected"))
