"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask trains on the assistant's words only. Context
roles (system) are no participants and keep their role.

The result has one row for each turn of each rendering: its segment, the place of the segment in
the rendering and the part of it that is trained on, so that a conversation of any length needs
no task or row that holds it whole. Places come from sums over blocks of turns, and sums within a
block. render() joins the segments of one conversation.

A conversation of t turns and p participants has t * p rows: the rotation is the feature.

Words can't forge a mark: `<|` in a text, role or name is written `<\\|`, and `<\\` before it `<\\\\`, so that unescape() gives the text
back; line breaks in a role or name are spaces.

Defined cases: turns are ordered by turn, nulls first, ties by role and text; a null role is the
participant `unknown`, a null text is empty; a null conv_id is a conversation of its own; repeated
rows are turns of their own; a conversation of context turns only has no rendering; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a block, in which one task adds up places.
BLOCK = 256
CONTEXT = ("system",)


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return text.replace("<\\|", "<|").replace("<\\\\", "<\\")


def rotate(turns: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """(conv_id, perspective, seq, turn, role, name, segment, start, stop, mask_start, mask_stop); places in code points.

    mask_start and mask_stop are null where nothing is trained on, and else cover the words and the end mark.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    views = rows.filter(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(views, rows["conv_id"].eqNullSafe(views["c"])).drop("c")
    role = F.when(F.col("speaker").isin(*context), F.col("speaker")).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    line = lambda c: escape(F.regexp_replace(c, r"[\r\n]+", " "))
    head = F.concat(F.lit("<|im_start|>"), line(role), F.coalesce(F.concat(F.lit(" name="), line(name)), F.lit("")), F.lit("\n"))
    first = F.lit(-(1 << 63)).cast("long")  # null turns come before all blocks
    parts = seen.withColumns({"role": role, "name": name, "segment": F.concat(head, escape(F.col("text")), F.lit("<|im_end|>\n")), "head": F.length(head), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), first)})
    parts = parts.withColumn("chars", F.length("segment"))
    key = ["conv_id", "perspective"]
    blocks = parts.groupBy(*key, "block").agg(F.sum("chars").alias("block_chars"), F.count("*").alias("block_turns"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"b_{k}") for k in [*key, "block"]], F.coalesce(F.sum("block_chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("block_turns").over(before), F.lit(0)).alias("turns_before"))
    placed = parts.join(blocks, parts["conv_id"].eqNullSafe(blocks["b_conv_id"]) & (parts["perspective"] == blocks["b_perspective"]) & (parts["block"] == blocks["b_block"]))
    inside = Window.partitionBy(*key, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    stop = F.col("chars_before") + F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumns({"seq": F.col("turns_before") + F.row_number().over(inside) - 1, "stop": stop}).withColumn("start", F.col("stop") - F.col("chars"))
    own = F.col("role") == "assistant"
    return placed.select(*key, F.col("seq").cast("long").alias("seq"), "turn", "role", "name", "segment", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.when(own, F.col("start") + F.col("head")).cast("long").alias("mask_start"), F.when(own, F.col("stop") - 1).cast("long").alias("mask_stop"))


def render(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks): whole renderings, for conversations that fit a row."""
    masks = F.sort_array(F.collect_list(F.when(F.col("mask_start").isNotNull(), F.struct("mask_start", "mask_stop"))))
    parts = rotated.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("seq", "segment"))).alias("s"), masks.alias("masks"))
    return parts.select("conv_id", "perspective", F.array_join("s.segment", "").alias("text"), "masks")
