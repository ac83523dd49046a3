"""Chat formatting by perspective rotation, DataFrame functions only.

Every participant of a conversation (a role other than system) is once the assistant. In that rendering its own turns are the
assistant's and are trained on; turns of others are users' with their role as name; system turns stay system turns. The mask is given
as spans of characters: the text and end mark of the assistant's turns.

A rendering is cut into pieces so that no row or group grows with a conversation: a block holds the turns of one range of
``block_turns`` turn numbers, and a piece at most ``block_turns`` of its rows. Grouping is by (conversation, block), so a conversation
of a third of all turns is spread over many groups. Pieces in order of (block, piece) make up the dialogue. With ``block_turns=None``
every dialogue is one row, for tables whose longest conversation is known to fit a task.

Turns are ordered by number, then role, then text; repeated rows are kept. A null text is empty, a null role is a user without name and
no participant, a null turn comes first (block -1), and turns without conversation form one of their own. Control marks inside a
text or a role are broken by a space, and a line break in a role's name is a space in the heading. A conversation without
participant, and an empty table, give no row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 64
START, END = "<|im_start|>", "<|im_end|>"


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def heading(role: Column, speaker: Column) -> Column:
    name = F.translate(unmarked(role), "\n\r", "  ")
    return F.concat(F.lit(START), F.when(role == speaker, "assistant").when(role == "system", "system")
                    .otherwise(F.concat(F.lit("user"), F.coalesce(F.concat(F.lit(" name="), name), F.lit("")))), F.lit("\n"))


def pieces(turns: DataFrame, conv: str, turn: str, role: str, text: str, block_turns: int | None = BLOCK_TURNS) -> DataFrame:
    """(conv_id, block, piece, turns): at most ``block_turns`` turns (None: all), in order, as structs of (turn, role, text)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
        unmarked(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    if block_turns is None:
        rows = rows.withColumns({"block": F.lit(0), "piece": F.lit(0)})
    else:
        rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)))
        along = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
        rows = rows.withColumn("piece", F.floor((F.row_number().over(along) - 1) / block_turns))
    return rows.groupBy("conv_id", "block", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block_turns: int | None = BLOCK_TURNS) -> DataFrame:
    """One row per conversation, participant and piece: conv_id, speaker, block, piece, n_turns, rendered, mask, n_target_chars.

    ``mask`` lists start-end pairs of characters of ``rendered`` (end not included), comma-joined.
    """
    speakers = (turns.select(F.col(conv).alias("conv"), F.col(role).cast("string").alias("speaker"))
                .where("speaker is not null and speaker <> 'system'").distinct())
    told = pieces(turns, conv, turn, role, text, block_turns)
    told = told.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv")))
    parts = told.select("conv_id", "speaker", "block", "piece", F.transform("turns", lambda x: F.struct(
        heading(x["role"], F.col("speaker")).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"),
        F.coalesce(x["role"] == F.col("speaker"), F.lit(False)).alias("own"))).alias("parts"))
    sizes = parts.withColumn("sizes", F.transform("parts", lambda x: F.length(x["head"]) + F.length(x["body"]) + 1))

    def before(i: Column) -> Column:
        return F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, x: a + x)

    spans = F.filter(F.transform("parts", lambda x, i: F.when(x["own"], F.struct(
        (before(i) + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))), lambda x: x.isNotNull())
    ready = sizes.withColumn("spans", spans)
    return ready.select(
        "conv_id", "speaker", F.col("block").cast("long").alias("block"), F.col("piece").cast("long").alias("piece"),
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["start"] + x["length"])), ",").alias("mask"),
        F.aggregate("spans", F.lit(0), lambda a, x: a + x["length"]).cast("long").alias("n_target_chars"))
