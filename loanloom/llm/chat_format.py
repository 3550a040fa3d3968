"""Render dialogues once per participant, with that speaker as the assistant.

A conversation of n speakers becomes n training dialogues. In each one the turns of one speaker
carry the role ``assistant`` and are the only ones a loss mask covers; every other speaker is a
``user`` with a name, and ``system`` turns stay what they are. Long conversations are cut into
segments of ``SEGMENT_TURNS`` turn numbers, and a segment that still has more turns (many with the
same number) into parts, so no row ever gathers a conversation of unknown length; masks count
characters within their part.

Defined results: turns are in order of ``turn`` (NULL last), then role, then text; a row that
repeats in all four columns is one turn; NULL text is an empty turn; a NULL or empty role is the
speaker ``unknown``; NULL ``conv_id`` is a conversation of its own; a conversation with system
turns only has no participant and gives no row, nor does an empty table. Roles and texts are told
apart as they are stored. In the dialogue ``<|`` within a text becomes ``< |``; a name doubles its
backslashes and spells ``<|`` and a line feed with one, so no turn can forge another one and no two
speakers share a name. A dialogue of more than ``SEGMENT_TURNS`` turns is several rows. Rows without
``conv_id`` form one dialogue with a rendering for every stray speaker. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_TURNS = 256
SYSTEM = "system"
UNKNOWN = "unknown"
START, STOP = "<|im_start|>", "<|im_end|>"


def _harmless(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    """A role as it stands in a header; different roles stay different."""
    for plain, spelled in (("\\", "\\\\"), ("<|", "<\\|"), ("\n", "\\n")):
        role = F.replace(role, F.lit(plain), F.lit(spelled))
    return role


def _head(role: Column, speaker: Column) -> Column:
    """First line of a turn, up to where its text begins."""
    who = (F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == speaker, F.lit("assistant"))
           .otherwise(F.concat(F.lit("user name="), _name(role))))
    return F.concat(F.lit(START), who, F.lit("\n"))


def perspectives(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """``conv_id, speaker, segment, part, n_turns, n_spoken, text, mask`` for every participant.

    ``mask`` lists the stretches of ``text`` to train on as ``start, stop`` (0-based, stop not
    included): the speaker's words with the end marker.
    """
    role = F.when(F.col("role") != "", F.col("role")).otherwise(F.lit(UNKNOWN))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    segment = F.floor(F.coalesce(F.col("turn"), F.lit(2 ** 62)) / segment_turns)
    order = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    part = F.floor((F.row_number().over(order) - 1) / segment_turns)
    blocks = (rows.withColumn("segment", segment).withColumn("part", part).groupBy("conv_id", "segment", "part")
              .agg(F.array_sort(F.collect_list(F.struct(
                  F.col("turn").isNull().alias("late"), "turn", "role", "text"))).alias("turns")))
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    both = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    speaker = F.col("speaker")
    parts = F.transform("turns", lambda t: F.struct(
        F.length(_head(t["role"], speaker)).alias("before"), (F.length(_harmless(t["text"])) + len(STOP)).alias("words"),
        (t["role"] == speaker).alias("spoken")))
    # one pass over the turns: where the next one begins, and the stretches found so far
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
    marked = F.aggregate(parts, empty, lambda seen, p: F.struct(
        (seen["at"] + p["before"] + p["words"] + 1).alias("at"),
        F.when(p["spoken"], F.concat(seen["found"], F.array(F.struct(
            (seen["at"] + p["before"]).alias("start"), (seen["at"] + p["before"] + p["words"]).alias("stop")))))
        .otherwise(seen["found"]).alias("found")), lambda seen: seen["found"])
    text = F.array_join(F.transform("turns", lambda t: F.concat(
        _head(t["role"], speaker), _harmless(t["text"]), F.lit(STOP + "\n"))), "")
    return both.select("conv_id", "speaker", "segment", "part",
                       F.size("turns").cast("long").alias("n_turns"),
                       F.size(F.filter("turns", lambda t: t["role"] == speaker)).cast("long").alias("n_spoken"),
                       text.alias("text"), marked.alias("mask"))


SQL = r"""
WITH rows AS (
  SELECT DISTINCT conv_id, turn, CASE WHEN role <> '' THEN role ELSE 'unknown' END AS role, coalesce(text, '') AS text
  FROM conversations),
parted AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS LAST, role, text) - 1) // 256 AS part
  FROM (SELECT *, floor(coalesce(turn, 4611686018427387904) / 256)::BIGINT AS segment FROM rows)),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role <> 'system'),
lined AS (
  SELECT r.conv_id, s.speaker, r.segment, r.part, r.turn, r.role, r.text AS stored, replace(r.text, '<|', '< |') AS text,
         r.role = s.speaker AS spoken,
         '<|im_start|>' || CASE WHEN r.role = 'system' THEN 'system' WHEN r.role = s.speaker THEN 'assistant'
                                ELSE 'user name=' || replace(replace(replace(r.role, '\', '\\'), '<|', '<\|'), chr(10), '\n') END || chr(10) AS head
  FROM parted r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS line,
         coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, speaker, segment, part ORDER BY turn NULLS LAST, role, stored
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM lined)
SELECT conv_id, speaker, segment, part, count(*) AS n_turns, count(*) FILTER (WHERE spoken) AS n_spoken,
       string_agg(line, '' ORDER BY turn NULLS LAST, role, stored) AS text,
       coalesce(string_agg(CASE WHEN spoken THEN start || ':' || (start + length(text) + 10) END, ','
                           ORDER BY turn NULLS LAST, role, stored), '') AS mask
FROM placed GROUP BY conv_id, speaker, segment, part
"""
