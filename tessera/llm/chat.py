"""Chat formatting: multi-party perspective rotation.

Each participant of a conversation, anyone but the system, gets the dialogue from their side: their turns are the
assistant's, those of others are users' with the speaker's name, system turns stay.  Only the assistant's turns, with
their end mark, are in the loss mask.

The result has a row for each turn of each dialogue: its segment of the rendered text, the segment's place in it and
the masked part.  The segments in the order of `start` are the dialogue.  So no conversation, however long, is gathered
in one row or task; places are summed within blocks of BLOCK turn numbers and then over the blocks.  dialogues() joins
the segments where whole texts are wanted.

Only DataFrame functions are used.  Rows: a null text counts as empty, a null role as the participant "unknown"; turns
without number come first; rows without conv_id are one conversation.  Rows with equal turn numbers stand in the order
of role and text, repeated rows stay repeated.  Marks within a text are not escaped, the places tell them apart.  A
conversation of system turns alone has no participant and no row.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SYSTEM = "system"
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def perspective_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, role, name, segment, start, end, mask_start, mask_end) of every turn of every dialogue.

    Places count code points of the rendered dialogue, ends are exclusive; mask_start and mask_end are null outside the
    mask.  role is assistant, user or system; name is the speaker of a user's turn.
    """
    turns = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    people = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = rows.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(BEGIN), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(END))).withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))
    dialogue = ["conv_id", "perspective"]
    totals = rows.groupBy(*dialogue, "block").agg(F.sum(F.length("segment")).alias("size"))
    before = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), (F.sum("size").over(Window.partitionBy(*dialogue).orderBy("block")) - F.col("size")).alias("before"))
    order = Window.partitionBy(*dialogue, "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(F.length("segment")).over(order))
    rows = rows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    end = F.col("before") + F.col("upto")
    start = end - F.length("segment")
    masked = F.col("role") == "assistant"
    return rows.select("conv_id", "perspective", "turn", "role", "name", "segment", start.alias("start"), end.alias("end"), F.when(masked, start + F.length("head")).alias("mask_start"), F.when(masked, end).alias("mask_end"))


def dialogues(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, mask) of each dialogue; mask is array<struct<start, end>>.  A row holds a whole dialogue."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end"))).alias("x")
    rows = segments.groupBy("conv_id", "perspective").agg(ordered)
    mask = F.transform(F.filter("x", lambda s: s["mask_end"].isNotNull()), lambda s: F.named_struct(F.lit("start"), s["mask_start"], F.lit("end"), s["mask_end"]))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("x", lambda s: s["segment"]), "").alias("text"), mask.alias("mask"))
