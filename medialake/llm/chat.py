"""Preference formatting of conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, turns array<struct<role, text>>`` in order of turn.

    Equal turn numbers are ordered by role, then text; a null role or text
    becomes the empty string. Rows without conv_id belong to no conversation.
    A conversation is one training record, so its turns may meet in one row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def last_reply(turns: Column) -> Column:
    """1-based position of the last assistant turn, 0 where there is none."""
    flags = F.transform(turns, lambda x: x["role"] == "assistant")
    back = F.array_position(F.reverse(flags), True)
    return F.when(back > 0, F.size(turns) + 1 - back).otherwise(0).cast("int")


def sampled_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: ``pair_id, chosen, rejected``.

    Conversations 2k and 2k+1 are partners. The chosen side is a conversation up
    to its last assistant turn, the rejected side the same with the last
    assistant turn of its partner in that place. Without a partner, or a reply
    on both sides, there is no pair.
    """
    rows = conversations_as_rows(turns).withColumn("at", last_reply(F.col("turns"))).where("at > 0")
    replies = rows.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("turns", F.col("at")).alias("other"))
    return rows.join(replies, "conv_id").select(
        F.col("conv_id").alias("pair_id"),
        F.slice("turns", 1, F.col("at")).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), F.array("other")).alias("rejected"),
    )


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def render(turns: Column) -> Column:
    """``<|role|>`` line, text and line end for every turn."""
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n"))), "")


def loss_spans(turns: Column) -> Column:
    """Character ranges of a rendering that carry loss: text and line end of assistant turns."""
    head = lambda x: F.length(x["role"]) + 5
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, x):
        begin = acc["at"] + head(x)
        end = begin + F.length(x["text"]) + 1
        more = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], more)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Prompt and paired masked completions of preference pairs.

    ``chosen`` and ``rejected`` are arrays of ``struct<role, text>``. Their
    longest common turn prefix is rendered once as ``prompt``; what follows on
    either side is a completion whose ``*_loss`` lists the character ranges that
    carry loss. Sides that are equal leave empty completions; a null side counts
    as one without turns. The columns of ``pairs`` other than the two sides are
    kept; outputs replace columns of the same name.
    """
    a, b = (F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")) for c in (chosen, rejected))
    clean = lambda x: F.transform(x, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = pairs.withColumns({"__a": clean(a), "__b": clean(b)}).withColumn("__n", common_turns(F.col("__a"), F.col("__b")))
    rest = lambda x: F.slice(F.col(x), F.col("__n") + 1, F.size(x))
    rows = rows.withColumns({"__c": F.when(F.size("__a") > F.col("__n"), rest("__a")).otherwise(F.slice("__a", 1, 0)), "__r": F.when(F.size("__b") > F.col("__n"), rest("__b")).otherwise(F.slice("__b", 1, 0))})
    out = rows.withColumns(
        {
            "prompt_turns": F.col("__n"),
            "prompt": render(F.slice("__a", F.lit(1), F.col("__n"))),
            "chosen_completion": render(F.col("__c")),
            "rejected_completion": render(F.col("__r")),
            "chosen_loss": loss_spans(F.col("__c")),
            "rejected_loss": loss_spans(F.col("__r")),
        }
    )
    return out.drop("__a", "__b", "__n", "__c", "__r", chosen, rejected)
