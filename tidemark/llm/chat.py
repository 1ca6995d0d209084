"""Chat formatting by perspective rotation.

For every participant of a conversation, the dialogue is rendered with that
speaker as the assistant and the others as named users, and masks tell which of
it is trained on: content and end mark of that speaker's turns (system turns
stay system turns and are no participants). Turns meet the list of participants
by a join, dealt so that a hot conversation is spread over tasks, and a dialogue
is given in parts of PART_TURNS turn numbers, so that no task or row holds a
conversation of any length. Marks in contents are escaped, and in a name all but
letters, digits, points, lines and hyphens are replaced, so that no text can
begin a turn. Only built-in functions run.

Defined results: a null text is rendered empty; texts of any length are rendered
whole; a turn with a null role has the speaker "unknown"; turns with a null
conv_id are one conversation; turns with the same number (ties) are rendered in
the order of speaker and content, and repeated rows each; null turn numbers are
a part of their own, the first; a conversation of system turns alone has no
perspective; an empty table gives an empty result; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up

#: Turn numbers in a part of a dialogue.
PART_TURNS = 256
HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"


def escaped(content: Column) -> Column:
    """A content in which no mark begins."""
    return F.replace(content, F.lit("<|"), F.lit("<\\|"))


def named(speaker: Column) -> Column:
    return F.regexp_replace(speaker, r"[^\p{L}\p{N}_.-]", "_")


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, mask_start, mask_end, trained.

    mask_start and mask_end (code points in the segment, end exclusive) bound
    what the loss counts: content and end mark of the assistant's turns; both
    are 0 elsewhere. A user's name stands after its role.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))
    rows = turns.select(key.alias("_k"), F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    views = rows.where(F.col("speaker") != system).select(F.col("_k").alias("_of"), F.col("speaker").alias("perspective")).distinct()
    met = looked_up(rows, "_k", views, "_of", "turn", "content")
    kind = F.when(F.col("speaker") == system, F.lit("system")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    head = F.concat(F.lit(HEAD), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), named(F.col("speaker")))).otherwise(F.lit("")), F.lit(MIDDLE))
    out = met.withColumn("role", kind).withColumn("_head", head).withColumn("segment", F.concat("_head", "content", F.lit(TAIL)))
    mine = F.col("role") == "assistant"
    return out.select(
        "conv_id", "perspective", "turn", "speaker", "role", "segment",
        F.when(mine, F.length("_head")).otherwise(0).alias("mask_start"), F.when(mine, F.length("segment")).otherwise(0).alias("mask_end"), mine.alias("trained"),
    )


def dialogues(rotated: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, turns, text, masks (arrays of start, end in code points of the text): whole dialogues in turn order, in parts of so many turn numbers."""
    part = F.floor(F.col("turn") / part_turns).cast("long")
    rows = F.array_sort(F.collect_list(F.struct("turn", "speaker", "segment", "mask_start", "mask_end")))
    lists = rotated.groupBy("conv_id", "perspective", part.alias("part")).agg(rows.alias("rows"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, r) -> Column:
        mask = F.array(F.struct((acc["at"] + r["mask_start"]).alias("start"), (acc["at"] + r["mask_end"]).alias("end")))
        return F.struct((acc["at"] + F.length(r["segment"])).alias("at"), F.when(r["mask_end"] > 0, F.concat(acc["out"], mask)).otherwise(acc["out"]).alias("out"))

    whole = F.array_join(F.transform("rows", lambda r: r["segment"]), "")
    return lists.select("conv_id", "perspective", "part", F.size("rows").alias("turns"), whole.alias("text"), F.aggregate("rows", start, step)["out"].alias("masks"))
