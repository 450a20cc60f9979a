"""Chat formatting by multi-party perspective rotation (native).

For every participant of a conversation (each distinct role or speaker) the dialogue is rendered once,
with that speaker's turns as ``assistant`` and all others as named users:
``<|im_start|>assistant\\nTEXT<|im_end|>\\n`` or ``<|im_start|>user name=SPEAKER\\nTEXT<|im_end|>\\n``.
The loss mask covers the text and end mark of the assistant turns only. So that no text can open or close a turn,
each ``<|`` in texts and names is written ``<||`` (undone by the opposite replacement), and line breaks in names as spaces.

The result has one row for each perspective and turn with its rendered segment, its place in the
rendered dialogue and its mask range, so that a conversation of any length is never gathered in one
task. Turns are numbered by a range sort, which parts a long conversation, and also one whose turns share a number. Places
are running sums of lengths, first over blocks of ``block`` turns by participant, then within a block; texts take no part in that
and are joined last, by the number of the turn. ``assemble`` joins the segments of conversations that are known to be short.

Defined results: a null speaker is the participant "unknown"; a null text is empty; null conversations
form one group; turns are ordered by turn (null first), then speaker, then text, and repeated turns stay;
an empty table gives an empty result; other columns are ignored, also those named like the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ordinal import with_ordinal
from ._common import materialize

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def user_head(speaker: Column) -> Column:
    return F.concat(F.lit(f"{OPEN}user name="), escaped(F.translate(speaker, "\n\r", "  ")), F.lit("\n"))


OWN_HEAD = f"{OPEN}assistant\n"


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join on columns of the same names, which stay once."""
    right = b.select(*[F.col(k).alias(f"_{k}_r") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}_r"))
    return a.join(right, on, how).drop(*[f"_{k}_r" for k in keys])


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, start, end, mask_start, mask_end (code points in
    the rendered dialogue, end exclusive; the mask of a user turn is empty, at its end)."""
    t = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    head = F.length(user_head(F.col("speaker")))
    t = t.withColumn("_size", (F.length("text") + len(CLOSE)).cast("long")).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    t = with_ordinal(t, "_n", "conv_id", "turn", "speaker", "text", "_tie").withColumn("_block", F.floor(F.col("_n") / block))
    narrow = t.select("conv_id", "_block", "_n", "speaker", "_size")
    # of each block: the characters of its turns as user turns, and how many each participant has
    own = materialize(narrow.groupBy("conv_id", "_block", "speaker").agg(F.sum(F.col("_size") + head).alias("_s"), F.count("*").alias("_c")), "blocks")
    upto = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", "_block").agg(F.sum("_s").alias("_s")).withColumn("_chars", F.coalesce(F.sum("_s").over(upto), F.lit(0))).drop("_s")
    people = own.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    grid = _same(blocks, people, ["conv_id"])
    counted = own.select("conv_id", "_block", F.col("speaker").alias("perspective"), "_c")
    before = Window.partitionBy("conv_id", "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    grid = _same(grid, counted, ["conv_id", "_block", "perspective"], "left").withColumn("_turns", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    # what a turn of one's own is shorter by than as a user turn
    less = F.length(user_head(F.col("perspective"))) - len(OWN_HEAD)
    grid = grid.select("conv_id", "_block", "perspective", (F.col("_chars") - F.col("_turns") * less).alias("_before"))
    rows = _same(narrow, grid, ["conv_id", "_block"])
    length = F.col("_size") + F.when(F.col("speaker") == F.col("perspective"), len(OWN_HEAD)).otherwise(head)
    inner = Window.partitionBy("conv_id", "_block", "perspective").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select(F.col("_n").alias("_m"), "perspective", (F.col("_before") + F.sum(length).over(inner)).alias("end"))
    out = t.select("conv_id", "turn", "speaker", "text", "_n").join(placed, F.col("_n") == F.col("_m"))
    mine = F.col("speaker") == F.col("perspective")
    opening = F.when(mine, F.lit(OWN_HEAD)).otherwise(user_head(F.col("speaker")))
    out = out.withColumn("segment", F.concat(opening, "text", F.lit(CLOSE))).withColumn("start", F.col("end") - F.length("segment"))
    return out.select(
        "conv_id", "perspective", "turn", "speaker", F.when(mine, "assistant").otherwise("user").alias("role"), "segment", "start", "end",
        F.when(mine, F.col("start") + len(OWN_HEAD)).otherwise(F.col("end")).alias("mask_start"),
        F.when(mine, F.col("end") - 1).otherwise(F.col("end")).alias("mask_end"),
    )


def assemble(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks: whole dialogues. Only for conversations known to fit in memory."""
    rows = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    out = rotated.groupBy("conv_id", "perspective").agg(rows.alias("_r"))
    spans = F.transform(F.filter("_r", lambda x: x["mask_start"] < x["mask_end"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return out.select("conv_id", "perspective", F.array_join(F.transform("_r", lambda x: x["segment"]), "").alias("text"), spans.alias("masks"))
