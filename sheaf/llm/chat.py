"""Preference formatting: what chosen and rejected conversations share is rendered once, the rest as masked completions.

DataFrame functions only. A conversation is one training example, so its turns come together in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def _clean(text: Column) -> Column:
    """Text that can't be taken for a mark of the template; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(HEAD), F.lit("< |"))


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), _clean(turn["role"]), F.lit(MIDDLE), _clean(turn["text"]), F.lit(TAIL))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def _segments(turns: Column) -> Column:
    """What is rendered, as (text, loss): loss 1 for the body and end of learned turns, 0 for heads and other turns."""
    def of(turn: Column) -> Column:
        head = F.concat(F.lit(HEAD), _clean(turn["role"]), F.lit(MIDDLE))
        body = F.concat(_clean(turn["text"]), F.lit(TAIL))
        return F.array(F.struct(head.alias("text"), F.lit(0).alias("loss")), F.struct(body.alias("text"), F.when(turn["role"] == LEARNED_ROLE, 1).otherwise(0).alias("loss")))

    return F.flatten(F.transform(turns, of))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first turns are equal in role and text (nulls equal nulls)."""
    equal = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Of (pair_id, chosen, rejected), both arrays of struct<role, text>: prompt, completions, masks and a status.

    Returns pair_id, n_prompt_turns, prompt, chosen_text, rejected_text, chosen_segments, rejected_segments and status:
    `identical` if nothing differs, `no_prompt` if nothing is shared, else `ok`. The segments of a completion join to its
    text; the prompt is never learned. A null conversation has no turns. A row in gives a row out, so repeated rows repeat
    and an empty table gives none; other columns are ignored, and texts of any length are rendered whole.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    turns = lambda c: F.transform(F.filter(F.coalesce(F.col(c), none), lambda t: t.isNotNull()), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pure = pairs.select("pair_id", turns("chosen").alias("c"), turns("rejected").alias("r"))
    split = pure.withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    cut = split.select("pair_id", F.col("n").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    status = F.when((F.size("c") == 0) & (F.size("r") == 0), "identical").when(F.col("n_prompt_turns") == 0, "no_prompt").otherwise("ok")
    return cut.select("pair_id", "n_prompt_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen_text"), _render(F.col("r")).alias("rejected_text"), _segments(F.col("c")).alias("chosen_segments"), _segments(F.col("r")).alias("rejected_segments"), status.alias("status"))


def mask_runs(segments: Column) -> Column:
    """A completion's mask as lengths in characters and their loss, `length:loss` joined by commas."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.char_length(s["text"]).cast("string"), F.lit(":"), s["loss"].cast("string"))), ",")


def gather_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order of (turn, role, text); nulls first, repeated rows repeat."""
    together = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    return together.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs made from (conv_id, turn, role, text): chosen is the conversation; rejected the same up to its last assistant turn, whose text is that of the next conversation's (conv_id + 1) last one.

    Without such a next conversation the rejected one ends before that turn; without an assistant turn both are the same.
    The largest conv_id has no next, and a null one is no other's next. An empty table gives no pair. Other columns are
    ignored; texts of any length are taken whole, but a conversation must fit a row.
    """
    turns = gather_turns(conversations)
    last = lambda c: F.array_max(F.transform(c, lambda t, i: F.when(t["role"] == LEARNED_ROLE, i)))
    known = turns.withColumn("at", last(F.col("turns")))
    answers = known.where("at is not null").select(F.try_subtract("conv_id", F.lit(1).cast("long")).alias("next_of"), F.get("turns", F.col("at"))["text"].alias("other"), F.lit(True).alias("has"))
    joined = known.join(answers, known["conv_id"] == answers["next_of"], "left")
    before = F.slice("turns", F.lit(1), F.col("at"))
    swapped = F.concat(before, F.array(F.struct(F.lit(LEARNED_ROLE).alias("role"), F.col("other").alias("text"))))
    rejected = F.when(F.col("at").isNull(), F.col("turns")).when(F.col("has"), swapped).otherwise(before)
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))
