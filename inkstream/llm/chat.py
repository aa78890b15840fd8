"""Chat formatting: multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation (each role but ``system``) the dialogue
is rendered once with that speaker as the assistant and all others as named
users. A row is one turn of one rendering: its text, its place in the rendering
in code points, and the part that a trainer should learn (the assistant's words
and end mark; nothing of other speakers).

Turns are ordered by (turn, role, text). Offsets are running sums; they are
taken within blocks of ``block`` turn numbers and over the blocks' sums, so that
one conversation with a large part of all rows is still spread over tasks.

Defined results: a null text is empty, a null role is the participant
``unknown``; rows with a null conv_id form one conversation; null turns come
first; repeated rows are turns of their own; a conversation in which only the
system speaks, like an empty table, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, block: int = 64) -> DataFrame:
    # a conversation's key without nulls, so that joins and windows can share a partitioning
    t = turns.select(
        F.coalesce("conv_id", F.lit(0)).alias("key"), F.col("conv_id").isNull().alias("none"),
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).alias("block"),
    )
    conversation, part = ["key", "none"], ["key", "none", "block"]
    seats = t.where(F.col("role") != "system").select(*conversation, F.col("role").alias("perspective")).distinct()
    # seats of each block: what meets on the conversation alone are distinct rows, not turns
    seats = t.select(*part).distinct().join(seats, conversation)
    own = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == "system", F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("role")))
    seen = (
        t.join(seats, part)
        .select(*part, "conv_id", "perspective", "turn", "role", "text", own.alias("learn"), F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"))
        .withColumn("segment", F.concat("head", "text", F.lit(CLOSE)))
    )
    sums = seen.groupBy(*part, "perspective").agg(F.sum(F.length("segment")).alias("size"))
    over_blocks = W.partitionBy(*conversation, "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*part, "perspective", F.coalesce(F.sum("size").over(over_blocks), F.lit(0)).alias("base"))
    within = W.partitionBy(*part, "perspective").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("base") + F.sum(F.length("segment")).over(within)
    return seen.join(starts, [*part, "perspective"]).withColumn("char_end", end.cast("long")).select(
        "conv_id", "perspective", "turn", "segment", "learn",
        (F.col("char_end") - F.length("segment")).alias("char_start"), "char_end",
        F.when(F.col("learn"), F.col("char_end") - F.length("segment") + F.length("head")).cast("long").alias("mask_start"),
        F.when(F.col("learn"), F.col("char_end")).alias("mask_end"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
seats AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
seen AS (
  SELECT t.conv_id, perspective, turn, role, text, role = perspective AS learn,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN seats ON t.conv_id IS NOT DISTINCT FROM seats.conv_id),
full_text AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM seen),
placed AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS char_end
  FROM full_text)
SELECT conv_id, perspective, turn, segment, learn, char_end - length(segment) AS char_start, char_end,
       CASE WHEN learn THEN char_end - length(segment) + length(head) END AS mask_start,
       CASE WHEN learn THEN char_end END AS mask_end
FROM placed
"""
