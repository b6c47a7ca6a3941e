"""Multi-party dialogues from every participant's side.

For each participant of a conversation the dialogue is rendered once more: that speaker's turns become the assistant's
and carry the training mask, all others become users with their names, and system turns stay what they are. A rendered
dialogue is kept as one row per message with its place and its character span, so that a conversation of any length is
never gathered into one row; the segments put together by position are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_sums

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "\n"
SYSTEM = "system"
NOBODY = "unknown"
#: Turns per slice of the running sums.
SLICE = 1024


def escaped(text):
    """Text in which no control sequence of the format can begin: a space is put into every `<|`."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation, participant and message.

    Columns: conv_id, perspective (the speaker who is the assistant), position (from 0), turn, role (system, assistant
    or user), name (the speaker; null for system), segment (the rendered message), masked (true: train on it), start
    and stop (characters of the segment in the dialogue), content_start and content_stop (of its text and end mark:
    what the loss covers where masked).

    Participants are the distinct roles other than system; a conversation of system turns alone has no rows. A null
    role is a participant called `unknown`, null text is empty, null conversation ids make one conversation, null
    turns come first. Equal turn numbers are ordered by role and text; repeated rows are repeated messages. An empty
    table gives no rows. Other columns are not read.
    """
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(NOBODY)).alias("speaker"),
        escaped(F.col(text_col)).alias("content"),
    )
    members = (
        said.where(F.col("speaker") != SYSTEM)
        .select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    role = (
        F.when(F.col("speaker") == SYSTEM, SYSTEM)
        .when(F.col("speaker") == F.col("perspective"), "assistant")
        .otherwise("user")
    )
    named = F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.regexp_replace("speaker", r"\s+", "_"))).otherwise("")
    rendered = (
        said.join(members, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .withColumn("role", role)
        .withColumn("head", F.concat(F.lit(OPEN), F.col("role"), named, F.lit(BREAK)))
        .select(
            "conv_id",
            "perspective",
            "turn",
            "role",
            F.when(F.col("role") != SYSTEM, F.col("speaker")).alias("name"),
            F.concat("head", "content", F.lit(CLOSE + BREAK)).alias("segment"),
            F.length("head").cast("long").alias("head_size"),
            F.length("content").cast("long").alias("content_size"),
        )
        .withColumn("size", F.length("segment").cast("long"))
        .withColumn("one", F.lit(1).cast("long"))
        .withColumn("slice", F.floor(F.col("turn") / SLICE))
    )
    order = ["turn", "role", "name", "segment"]
    placed = running_sums(rendered, ["conv_id", "perspective"], "slice", order, {"stop": "size", "count": "one"})
    start = F.col("stop") - F.col("size")
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("count") - 1).alias("position"),
        "turn",
        "role",
        "name",
        "segment",
        (F.col("role") == "assistant").alias("masked"),
        start.alias("start"),
        "stop",
        (start + F.col("head_size")).alias("content_start"),
        (start + F.col("head_size") + F.col("content_size") + len(CLOSE)).alias("content_stop"),
    )
