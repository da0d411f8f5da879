"""Preference formatting: common prompt of a chosen and a rejected conversation, and masked completions.

The longest common prefix of turns (equal role and text) is rendered once as the prompt; what follows on
either side is its completion.  The mask of a completion lists the character ranges of assistant content,
end mark included, as ``start-end`` pairs; everything else is not trained on.

Defined cases: null roles and texts are empty; turns are ordered by ``turn``, then role and text, nulls first;
equal conversations give two empty completions; a side without turns gives an empty completion and no
prompt; turns without a pair id form one pair; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import ready

# The template's marks around a turn.
BEGIN = "<|im_start|>"
END = "<|im_end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Ranges of assistant content in the rendered turns, such as ``10-25,80-92``."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.lit(len(BEGIN) + 1) + F.char_length(turn["role"])
        end = begin + F.char_length(turn["text"]) + F.lit(len(END))
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(
            done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, empty, step, lambda done: done["spans"]), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """From ``pair_id, side, turn, role, text`` (side ``chosen`` or ``rejected``) one row per pair.

    Result: ``pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``.
    """
    ready(turns.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def side(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("side") == name, turn)))
        return F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name)

    pairs = turns.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    pairs = pairs.withColumn("first", F.array_position(same, F.lit(False)))
    pairs = pairs.select(
        "pair_id", "chosen", "rejected",
        F.when(F.col("first") > 0, F.col("first") - 1).otherwise(F.size("chosen")).cast("int").alias("n"))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))

    pairs = pairs.select("pair_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("shared"),
                         rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return pairs.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _render(F.col("shared")).alias("prompt"),
        _render(F.col("chosen")).alias("chosen"), _render(F.col("rejected")).alias("rejected"),
        _mask(F.col("chosen")).alias("chosen_mask"), _mask(F.col("rejected")).alias("rejected_mask"))


def preference_turns(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: the rejected side answers with another conversation's last answer.

    Conversation ``2 k`` and ``2 k + 1`` lend each other the text of their last assistant turn; where the
    other has none, the answer is empty.  Conversations without an assistant turn have two equal sides.
    """
    last = conversations.where("role = 'assistant'").groupBy("conv_id").agg(
        F.max_by("text", F.struct("turn", "text")).alias("answer"), F.max("turn").alias("turn"))
    lent = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("lent"))
    swapped = conversations.join(
        last.select("conv_id", F.col("turn").alias("last")), "conv_id", "left").join(lent, "conv_id", "left")
    other = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"),
                   F.coalesce("lent", F.lit(""))).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
                    F.struct(F.lit("rejected").alias("side"), other.alias("text")))
    return swapped.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select(
        "pair_id", "s.side", "turn", "role", "s.text")
