"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered anew with that speaker as the assistant
and all others as users who are called by their names; only the assistant's words and the end mark after them
are to be learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turn numbers of a chunk: offsets are summed within a chunk, then over chunks.
CHUNK = 256


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row for each conversation, perspective (a participant) and turn, which in the order of position
    (from 1) concatenate to the rendered dialogue: conv_id, perspective, position, turn, role, name, segment,
    seg_start, seg_end (characters of the rendering), learned (this turn is the perspective's own), mask_start, mask_end
    (the characters to be learned; null if there are none).

    Speakers in narrators are no participants: their turns are kept as they are in every perspective; a
    conversation without participants gives no rows. Turns are in the order of turn (null first),
    speaker, text; repeated turns stay. A null text is empty, a null speaker is the participant "". The mark
    "<|" inside texts and names is rendered as "< |", so no text can pose as a turn. An empty
    table gives no rows; only the four columns named are read.
    """
    safe = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), safe(F.col(speaker)).alias("speaker"), safe(F.col(text)).alias("text"))
    fixed = F.col("speaker").isin(*narrators) if narrators else F.lit(False)
    people = rows.where(~fixed).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    out = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    learned = F.col("speaker") == F.col("perspective")
    role = F.when(fixed, F.col("speaker")).when(learned, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~fixed & ~learned, F.col("speaker"))
    head = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("|>\n"))
    out = out.select("*", role.alias("role"), name.alias("name"), learned.alias("learned"), F.length(head).cast("long").alias("head"), F.concat(head, F.col("text"), F.lit("<|end|>\n")).alias("segment"))
    out = out.withColumn("size", F.length("segment").cast("long")).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    one = ("conv_id", "perspective")
    chunks = out.groupBy(*one, "chunk").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    over = W.partitionBy(*one).orderBy("chunk")
    chunks = chunks.select(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"), F.col("chunk").alias("_chunk"), (F.sum("size").over(over) - F.col("size")).alias("chars_before"), (F.sum("rows").over(over) - F.col("rows")).alias("rows_before"))
    within = W.partitionBy(*one, "chunk").orderBy("turn", "speaker", "text")
    so_far = within.rowsBetween(W.unboundedPreceding, 0)
    out = out.select("*", F.sum("size").over(so_far).alias("chars"), F.row_number().over(within).alias("number"))
    out = out.join(chunks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")) & F.col("chunk").eqNullSafe(F.col("_chunk")))
    end = F.col("chars_before") + F.col("chars")
    start = end - F.col("size")
    return out.select(
        "conv_id", "perspective", (F.col("rows_before") + F.col("number")).cast("long").alias("position"), "turn", "role", "name", "segment",
        start.alias("seg_start"), end.alias("seg_end"), "learned",
        F.when(F.col("learned"), start + F.col("head")).alias("mask_start"), F.when(F.col("learned"), end - 1).alias("mask_end"),
    )
