"""Chat formatting by multi-party perspective rotation (operator 6).

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask marks the assistant's words. A dialogue's text is
told in pieces of ``PART`` turns, so that no group of rows grows with the data; the pieces joined in order
are the whole text, and masks count from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table

#: Turn numbers of a part.
PART = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def plain(text: Column) -> Column:
    """A text that can't be taken for the format's own marks: ``<|im_`` is broken by a blank."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def named(role: Column) -> Column:
    """A role as a name in a header: no marks, no line breaks."""
    return F.translate(plain(role), "\n\r", "  ")


def rotate(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """``(conv_id, perspective, part, offset, n_messages, text, mask)``.

    One row per dialogue, participant and part of ``PART`` turn numbers (one part for ordinary
    dialogues): the rendered dialogue is its parts' texts joined in order, whatever their number, and a
    part starts ``offset`` characters into it. Messages stand in order of turn, then role, then text; the perspective's own are
    ``<|im_start|>assistant``, the system's stay ``<|im_start|>system``, the others' are
    ``<|im_start|>user name=<role>``. ``mask`` lists ``start:end`` in characters of the
    whole dialogue, from 0, comma-separated: the assistant's words with their closing mark. Line
    breaks in a role are blanks in its name.

    Participants are the dialogue's distinct roles but the system (a dialogue of system turns only
    has no rows). Repeated rows are one message; a null text is empty; a null role speaks as a
    user with an empty name and isn't a participant; a null turn comes first; rows with a null
    conv_id belong to no dialogue. Empty table: no rows. Other columns are not read.
    """
    said = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), plain(F.col("text")).alias("words")).distinct()
    who = turns.where("conv_id IS NOT NULL AND role IS NOT NULL").where(F.col("role") != system).select("conv_id", F.col("role").alias("perspective")).distinct()
    out = said.join(who, "conv_id")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(F.col("role") == system, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), named(F.col("role")), F.lit("\n")))
    out = out.withColumns({"part": F.floor(F.coalesce("turn", F.lit(0)) / PART), "own": own, "head": head})
    out = out.withColumn("message", F.concat("head", "words", F.lit(f"{CLOSE}\n")))
    # Where each part starts: sums of its messages' lengths, combined before the shuffle.
    sizes = out.groupBy("conv_id", "perspective", "part").agg(F.sum(F.length("message")).alias("size"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "perspective", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("conv_id", "perspective", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "words")
    out = out.withColumns({"at": F.row_number().over(order), "stop": F.sum(F.length("message")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("stop") - F.length("message") + F.length("head")
    span = F.when(F.col("own"), F.struct(start.alias("a"), (F.col("stop") - 1).alias("b")))
    rows = F.array_sort(F.collect_list(F.struct("at", "message", span.alias("span"))))
    got = out.groupBy("conv_id", "perspective", "part").agg(rows.alias("rows")).join(starts, ["conv_id", "perspective", "part"])
    spans = F.filter("rows.span", lambda x: x.isNotNull())
    mask = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["a"] + F.col("offset"), x["b"] + F.col("offset"))), ",")
    return got.select("conv_id", "perspective", "part", "offset", F.size("rows").cast("long").alias("n_messages"), F.array_join("rows.message", "").alias("text"), mask.alias("mask"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS words
  FROM conversations WHERE conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND role <> 'system'),
headed AS (
  SELECT s.*, perspective, CAST(floor(coalesce(turn, 0) / 4096) AS BIGINT) AS part,
    CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user name=' || translate(replace(role, '<|im_', '< |im_'), chr(10) || chr(13), '  ') || chr(10) END AS head
  FROM said s JOIN who USING (conv_id)),
placed AS (
  SELECT *, head || words || '<|im_end|>' || chr(10) AS message,
    row_number() OVER (PARTITION BY conv_id, perspective ORDER BY part, turn NULLS FIRST, role, words) AS k,
    sum(length(head || words) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY part, turn NULLS FIRST, role, words ROWS UNBOUNDED PRECEDING) AS stop
  FROM headed)
SELECT conv_id, perspective, part, CAST(min(stop - length(message)) AS BIGINT) AS offset, count(*) AS n_messages, string_agg(message, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN role = perspective THEN CAST(stop - length(message) + length(head) AS BIGINT) || ':' || CAST(stop - 1 AS BIGINT) END, ',' ORDER BY k), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""
