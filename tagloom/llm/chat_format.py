"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns (equal role and text) is rendered once as the
prompt; the turns after it are rendered for either side.  A completion's mask
lists the character ranges that are learned from: the texts of its assistant
turns with their end mark.  All in DataFrame expressions; a conversation is
gathered into one row, because that row is the training example.

Defined cases: turns are sorted by turn, role and text (nulls first), and exact
repeats of a turn count once; null roles and texts are rendered as empty; a pair
without one of its sides is left out; equal conversations have empty completions
and no mask; a null pair_id is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lets import let
from tagloom.operators.numbering import number_rows

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>\n"


def _gathered(turns: DataFrame, name: str) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(F.sort_array(F.collect_set(turn)).alias(name))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END))


def _mask(turns: Column) -> Column:
    """start, end of the learned ranges of the rendered turns."""
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + len(START) + F.length(turn["role"]) + 1
        end = begin + F.length(turn["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, step, add, lambda state: state["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask; each side has pair_id, turn, role, text."""
    pairs = _gathered(chosen, "_chosen").join(_gathered(rejected, "_rejected"), "pair_id")
    shorter = F.least(F.size("_chosen"), F.size("_rejected"))
    same = F.zip_with("_chosen", "_rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    pairs = pairs.withColumn("prompt_turns", F.when(differs > 0, differs - 1).otherwise(shorter))
    rest = lambda side: F.slice(side, F.col("prompt_turns") + 1, F.size(side))
    join = lambda turns: F.array_join(F.transform(turns, _rendered), "")
    return pairs.select(
        "pair_id",
        "prompt_turns",
        join(F.slice("_chosen", 1, F.col("prompt_turns"))).alias("prompt"),
        join(rest("_chosen")).alias("chosen"),
        join(rest("_rejected")).alias("rejected"),
        let(rest("_chosen"), _mask).alias("chosen_mask"),
        let(rest("_rejected"), _mask).alias("rejected_mask"),
    )


def donated_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations.

    Chosen is a conversation as it is.  Rejected is its turns before the last
    assistant turn, then the last assistant text of the next conversation that has one,
    by conv_id, however far its id is; the first is next to the last.  The
    conversations are numbered by a range sort.  One without an assistant turn gives
    no pair; one alone meets itself, which leaves both completions empty.
    """
    talks = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = talks.filter("role = 'assistant' AND turn IS NOT NULL").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("l"))
    answered = number_rows(last.select("pair_id", F.col("l.turn").alias("cut"), F.col("l.text").alias("text")), [F.col("pair_id").asc()], "no")
    many = answered.count()
    donors = answered.select((F.pmod(F.col("no") - 2, F.lit(max(1, many))) + 1).alias("no"), F.col("text").alias("donated"))
    cut = answered.join(donors, "no").select("pair_id", "cut", "donated")
    before = talks.join(cut, "pair_id").filter("turn < cut OR turn IS NULL").select("pair_id", "turn", "role", "text")
    answers = cut.select("pair_id", F.col("cut").alias("turn"), F.lit("assistant").alias("role"), F.col("donated").alias("text"))
    return talks, before.unionByName(answers)


def mask_text(mask: str) -> Column:
    """A mask as text: 12-40,55-80."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
