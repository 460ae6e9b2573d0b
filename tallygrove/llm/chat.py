"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

Each participant of a conversation is the assistant once: that speaker's turns become assistant turns that carry the
training mask, all other speakers become named users, and system turns stay system turns in every rotation. The result
has one row per conversation, perspective and turn, with character offsets into the rendered dialogue, so that no
conversation is ever gathered into one row: a conversation may hold any share of the table.

Offsets are two-level prefix sums. Turns are dealt to blocks of ``BLOCK`` turn numbers; running sums inside a block are
added to the total of the blocks before it, and only block totals meet per conversation.

Defined cases: a row without conversation id belongs to no dialogue and is left out; a missing role is the speaker
``unknown``; a missing text is empty; a missing turn comes first; turns with equal numbers follow speaker, then text, and
repeated rows are all rendered; a conversation of system turns only has no participant and so no rotation. ``<|`` inside
a text or a name is written ``< |`` so that it cannot end a turn. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def rotate_perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system", block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, position (from 1), turn, speaker, segment, char_start, char_end, mask_start, mask_end.

    ``segment`` is the rendered turn; concatenated by position, segments are the dialogue. ``mask_start`` and
    ``mask_end`` bound the characters to learn (the assistant's words and the end mark), and are null elsewhere.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    base = turns.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("speaker"),
        safe(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"),
    ).where(F.col("conv_id").isNotNull())
    people = base.where(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    rows = base.join(people, "conv_id")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(F.col("speaker") == system, F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), safe(F.col("speaker")), F.lit("\n")))
    rows = rows.select(
        "conv_id", "perspective", "turn", "speaker", "body", own.alias("own"),
        F.floor(F.col("turn") / block).alias("block"), F.length(head).alias("head_chars"),
        F.concat(head, "body", F.lit("<|im_end|>\n")).alias("segment"),
    ).withColumn("chars", F.length("segment"))
    key = ["conv_id", "perspective"]
    inside = Window.partitionBy(*key, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("chars").over(inside)).withColumn("nth", F.count(F.lit(1)).over(inside))
    totals = rows.groupBy(*key, "block").agg(F.sum("chars").alias("block_chars"), F.count(F.lit(1)).alias("block_rows"))
    before = Window.partitionBy(*key).orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("block_chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_before"),
    )
    rows = rows.join(totals, (F.col("conv_id") == F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("block").eqNullSafe(F.col("b")))
    end = F.col("chars_before") + F.col("upto")
    start = end - F.col("chars")
    return rows.select(
        "conv_id", "perspective", (F.col("rows_before") + F.col("nth")).alias("position"), "turn", "speaker", "segment",
        start.alias("char_start"), end.alias("char_end"),
        F.when(F.col("own"), start + F.col("head_chars")).alias("mask_start"),
        F.when(F.col("own"), end - 1).alias("mask_end"),
    )


ORACLE_SQL = """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
rendered AS (
  SELECT b.conv_id, p.perspective, b.turn, b.speaker, b.body, b.speaker = p.perspective AS own,
    CASE WHEN b.speaker = p.perspective THEN '<|im_start|>assistant' || chr(10)
         WHEN b.speaker = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || replace(b.speaker, '<|', '< |') || chr(10) END AS head
  FROM base b JOIN people p ON b.conv_id = p.conv_id),
placed AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment, length(head || body || '<|im_end|>' || chr(10)) AS chars,
    row_number() OVER w AS position,
    sum(length(head || body || '<|im_end|>' || chr(10))) OVER w AS char_end
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, segment,
  CAST(char_end - chars AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
  CAST(CASE WHEN own THEN char_end - chars + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN own THEN char_end - 1 END AS BIGINT) AS mask_end
FROM placed
"""
