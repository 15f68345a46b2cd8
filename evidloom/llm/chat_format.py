"""Chat formatting by perspective rotation: each participant of a dialogue is once the assistant, the others are named users.

Only DataFrame functions are used. Places of messages come from running sums over a conversation, so a mask is read
off and not built up message by message. A row holds a whole dialogue; that row is what a long conversation costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END, SYSTEM = "<|im_start|>", "<|im_end|>", "system"
OWN, OTHER = "assistant", "user name="


def _guarded(text: Column) -> Column:
    """Markers inside a text are broken by a space, so that no text can pass for a turn."""
    for marker in (BEGIN, END):
        text = F.replace(text, F.lit(marker), F.lit(marker[:2] + " " + marker[2:]))
    return text


def perspectives(dialogues: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation and participant: conv_id, perspective, n_messages, text and mask.

    ``text`` has every message of the dialogue: the perspective's as assistant, system messages as system, others as
    ``user name=...``. ``mask`` holds the (start, end) code points that are trained on: the assistant's contents with
    their end markers. Messages come by turn, null last, ties by speaker and text; repeated rows are repeated messages.
    A null text is empty. A null speaker is a user without a name and has no perspective; neither has the system, so
    a conversation with no one else gives no row. A null conversation is one of its own. Speakers are told apart by
    their names as they are; in a rendered name a line feed is a space. Other columns are left out.
    """
    own = dialogues.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(speaker_col).cast("string").alias("speaker"), _guarded(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    shown = F.replace(_guarded(F.col("speaker")), F.lit("\n"), F.lit(" "))
    other = F.when(F.col("speaker").isNull(), F.lit("user")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit(OTHER), shown))
    named = own.withColumn("head", F.concat(F.lit(BEGIN), other, F.lit("\n"))).withColumn("body", F.concat("text", F.lit(END)))
    order = [F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), "text"]
    so_far, same = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id", "speaker").orderBy(*order)
    chars = F.length("head") + F.length("body") + 1
    # ``begin``: where the message begins if all speakers are others; ``nth``: how many of the speaker's own come before it.
    placed = named.withColumns({"place": F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)), "begin": F.coalesce(F.sum(chars).over(so_far), F.lit(0)), "nth": F.row_number().over(same) - 1})
    message = F.struct("place", "speaker", "head", "body", "begin", "nth")
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"), F.collect_set(F.when(F.col("speaker") != SYSTEM, F.col("speaker"))).alias("people"))
    each = whole.select("conv_id", F.explode("people").alias("perspective"), "messages")
    mine = f"{BEGIN}{OWN}\n"

    def trained(m: Column) -> Column:
        start = m["begin"] + m["nth"] * (len(mine) - F.length(m["head"])) + len(mine)
        return F.struct(start.cast("int").alias("start"), (start + F.length(m["body"])).cast("int").alias("end"))

    def is_own(m: Column) -> Column:
        return F.coalesce(m["speaker"] == F.col("perspective"), F.lit(False))

    return each.select(
        "conv_id", "perspective",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: F.concat(F.when(is_own(m), F.lit(mine)).otherwise(m["head"]), m["body"], F.lit("\n"))), "").alias("text"),
        F.transform(F.filter("messages", is_own), trained).alias("mask"),
    )


def listed(mask: Column) -> Column:
    """A mask as text: start-end, comma-joined."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql_guarded(text: str) -> str:
    return f"replace(replace({text}, '{BEGIN}', '<| im_start|>'), '{END}', '<| im_end|>')"


ORACLE = f"""
WITH own AS (SELECT conv_id, turn, role AS speaker, replace({_sql_guarded('role')}, chr(10), ' ') AS shown, {_sql_guarded("coalesce(text, '')")} AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker NULLS LAST, text) AS place FROM own),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM own WHERE speaker <> '{SYSTEM}'),
said AS (
  SELECT m.conv_id, p.perspective, place, coalesce(speaker = perspective, false) AS trained, text || '{END}' AS body,
    '{BEGIN}' || CASE WHEN speaker IS NULL THEN 'user' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN '{OWN}' ELSE '{OTHER}' || shown END || chr(10) AS head
  FROM placed m JOIN people p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
offsets AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY place) - length(body) - 1 AS start FROM said)
SELECT conv_id, perspective, count(*) AS n_messages, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(start || '-' || (start + length(body)), ',' ORDER BY place) FILTER (trained), '') AS mask
FROM offsets GROUP BY ALL
"""
