"""Preference formatting of chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered, in the public ChatML form: head, the text, tail.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations(turns: DataFrame, by: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(by, turns): the turns of each conversation in order, as structs of role and text.

    Null roles become ``user``, null texts are empty; turns without a number come first, equal numbers go by
    role and text. ``<|`` in a text or role is written ``< |``, so that no text can end its own turn.
    """
    clean = lambda c, empty: F.replace(F.coalesce(F.col(c), F.lit(empty)), F.lit("<|"), F.lit("< |"))
    one = F.struct(F.col(turn).alias("turn"), clean(role, "user").alias("role"), clean(text, "").alias("text"))
    listed = turns.groupBy(by).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return listed.select(by, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of turns that two arrays of turns share from the start."""
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    first = F.array_position(same, False)
    shortest = F.least(F.size(a), F.size(b))
    return F.when(shortest <= 0, F.lit(0)).otherwise(F.when(first > 0, first - 1).otherwise(shortest)).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(AFTER_ROLE), x["text"], F.lit(CLOSE))), "")


def trained_spans(turns: Column) -> Column:
    """The characters of ``render(turns)`` that count in the loss, as ``start:end`` joined by commas: the assistant's texts with their ends."""
    head, tail = len(OPEN) + len(AFTER_ROLE), len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + head + F.length(x["role"])
        end = first + F.length(x["text"]) + tail
        span = F.concat(first.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with n_prompt_turns, prompt, chosen_text, chosen_spans, rejected_text and rejected_spans.

    ``chosen`` and ``rejected`` are arrays of turns as ``conversations`` makes them; null counts as none. The
    longest common prefix of turns is rendered once as prompt; each side's completion is the rest, with the
    spans of it that are trained on. Equal conversations give two empty completions; repeated rows are formatted
    each; an empty table gives none. Columns of pairs by these names are replaced.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    made = pairs.withColumns({"__a": F.coalesce(F.col(chosen), empty), "__b": F.coalesce(F.col(rejected), empty)})
    made = made.withColumn("n_prompt_turns", common_prefix(F.col("__a"), F.col("__b")))
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    made = made.withColumns({"prompt": render(F.slice(F.col("__a"), F.lit(1), F.col("n_prompt_turns"))), "__a": rest("__a"), "__b": rest("__b")})
    cols = {f"{k}_{what}": f(F.col(c)) for k, c in (("chosen", "__a"), ("rejected", "__b")) for what, f in (("text", render), ("spans", trained_spans))}
    return made.withColumns(cols).drop("__a", "__b")


def swapped_answers(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(pair_id, chosen, rejected) of each conversation, for tables that hold no preferences: as it is, and with another's answer.

    rejected has the turns before the last of the assistant, then that of the conversation whose id differs in the
    lowest bit; null where either has none. pair_id is the id; rows without one are in no pair. A conversation is
    held in one row, however long; repeated turns count each; an empty table gives none; other columns are not read.
    """
    c = conversations(turns.where(F.col(conv_id).isNotNull()), conv_id).withColumnRenamed(conv_id, "pair_id")
    at = F.expr("array_max(transform(turns, (x, i) -> IF(x.role = 'assistant', i + 1, NULL)))")
    c = c.withColumn("at", at).withColumn("answer", F.when(F.col("at").isNotNull(), F.element_at("turns", F.col("at"))))
    side = lambda k: F.first(F.when(F.pmod("pair_id", F.lit(2)) == k, F.struct("pair_id", "turns", "at", "answer")), True)
    both = c.groupBy(F.floor(F.col("pair_id") / 2).alias("k")).agg(side(0).alias("x"), side(1).alias("y"))
    each = both.select(F.explode(F.array(F.struct(F.col("x").alias("own"), F.col("y.answer").alias("other")), F.struct(F.col("y").alias("own"), F.col("x.answer").alias("other")))).alias("p")).where("p.own IS NOT NULL")
    other = F.concat(F.slice("p.own.turns", F.lit(1), F.col("p.own.at") - 1), F.array("p.other"))
    return each.select("p.own.pair_id", F.col("p.own.turns").alias("chosen"), F.when(F.col("p.own.at").isNotNull() & F.col("p.other").isNotNull(), other).alias("rejected"))


def neighbour_pairs(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(pair_id, chosen, rejected) of conversations 2k and 2k + 1, for tables that hold no preferences; a missing one is null. Rows without an id are in no pair."""
    c = conversations(turns.where(F.col(conv_id).isNotNull()), conv_id)
    side = lambda k: F.first(F.when(F.pmod(F.col(conv_id), F.lit(2)) == k, F.col("turns")), True)
    return c.groupBy(F.floor(F.col(conv_id) / 2).alias("pair_id")).agg(side(0).alias("chosen"), side(1).alias("rejected"))
