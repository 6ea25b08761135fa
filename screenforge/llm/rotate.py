"""Multi-party chats: the dialogue once per participant, seen from that participant's side.

The chosen speaker becomes the assistant, every other speaker a named user; system turns stay
system turns. The loss mask covers what the chosen speaker says. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Text without the opening of a chat marker; null is empty."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, speaker, n_turns, n_own, rendered, mask): one row per dialogue and participant.

    ``turns`` has conv_id, turn, role, text; only these are read. Participants are the roles other
    than ``system``; a null role counts as system, as do blank ones. Turns go by turn number (null
    first), ties by role, then text; repeated rows stay repeated turns. Null texts are empty turns.
    Turns without conv_id belong to no dialogue: equal ones of them form a dialogue of their own.
    A dialogue with system turns only has no participant and so no row. ``mask`` lists
    [start, end) character offsets in ``rendered`` of what the speaker says, end marker included.

    A dialogue's turns meet in one row, since its rendering is one text. Rows of a dialogue are
    grouped once; the participants are exploded from the grouped row, never joined pair by pair.
    """
    speaker = F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))
    rows = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).alias("__own"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.when(speaker == "", "system").otherwise(_plain(speaker)).alias("who"),
            _plain(F.col("text")).alias("said"),
        ).alias("__turn"),
    )
    whole = rows.groupBy("conv_id", "__own").agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    people = F.array_sort(F.array_distinct(F.filter(F.transform("__turns", lambda t: t["who"]), lambda w: w != "system")))
    seen = whole.select("conv_id", "__turns", F.explode(people).alias("speaker"))

    def head(t: Column) -> Column:
        name = F.when(t["who"] == "system", F.lit("system")).when(t["who"] == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["who"]))
        return F.concat(F.lit(START), name, F.lit("\n"))

    parts = seen.withColumn("__parts", F.transform("__turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["said"], F.lit(END + "\n")).alias("body"), (t["who"] == F.col("speaker")).alias("own"))))
    # running offsets: the state is (characters so far, spans so far)
    step = F.aggregate(
        "__parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(s["spans"], F.array(F.array(s["at"] + F.length(p["head"]), s["at"] + F.length(p["head"]) + F.length(p["body"]) - 1)))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return parts.select(
        "conv_id", "speaker", F.size("__turns").cast("long").alias("n_turns"),
        F.size(F.filter("__parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        step.alias("mask"),
    )
