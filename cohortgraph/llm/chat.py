"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and everybody else as a named user; the mask tells
which characters are the speaker's own (text and end mark). DataFrame
functions only.

A conversation is rendered in parts of ``PART_TURNS`` turn numbers, so that a
conversation with a large share of all rows neither meets in one task nor in
one row; participants are those of the whole conversation. Conversations of
fewer turns have one part.

Defined cases
    * rows with a null conv_id belong to no conversation and are left out.
    * null turn: comes first, in part 0. Null role: the participant "unknown".
      Null text: as an empty text.
    * turns with equal numbers are ordered by role and text; repeated rows are
      repeated turns.
    * "<|" in a text or name is written "<\\|", so that no text can forge a mark;
      line breaks in a name become blanks.
    * an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
UNKNOWN = "unknown"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, n_turns, n_own, text, mask): mask is an array of (start, end) in characters."""
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long").alias("part"))
    parts = rows.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = rows.select("conv_id", F.col("role").alias("speaker")).distinct()
    each = parts.join(speakers, "conv_id")

    def segment(t: Column) -> Column:
        own = t["role"] == F.col("speaker")
        name = F.regexp_replace(_safe(t["role"]), r"[\r\n]+", " ")
        head = F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
        return F.struct(own.alias("own"), head.alias("head"), F.concat(_safe(t["text"]), F.lit(CLOSE)).alias("body"))

    each = each.withColumn("segments", F.transform("turns", segment))

    def place(at: Column, s: Column) -> Column:
        start = at["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(at["spans"], span)).otherwise(at["spans"]).alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))
    return each.select(
        "conv_id", "speaker", "part", F.size("segments").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("text"),
        F.aggregate("segments", nothing, place)["spans"].alias("mask"))


def op3_chat_rotation(spark, sf_dir: str) -> DataFrame:
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    spans = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  coalesce(CAST(floor(turn / 4096) AS BIGINT), 0) AS part,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                                     coalesce(text, '')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
g AS (SELECT t.conv_id, s.speaker, t.part, t.n, t.role = s.speaker AS own,
             CASE WHEN t.role = s.speaker THEN '<|im_start|>assistant' || chr(10)
                  ELSE '<|im_start|>user name=' || regexp_replace(replace(t.role, '<|', '<\|'), '[\r\n]+', ' ', 'g') || chr(10)
             END AS head,
             replace(t.text, '<|', '<\|') || '<|im_end|>' || chr(10) AS body
      FROM t JOIN s ON s.conv_id = t.conv_id),
p AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (
                  PARTITION BY conv_id, speaker, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                + length(head) AS own_start
      FROM g)
SELECT conv_id, speaker, part, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
       string_agg(head || body, '' ORDER BY n) AS text,
       coalesce(string_agg(CAST(CAST(own_start AS BIGINT) AS VARCHAR) || '-'
                           || CAST(CAST(own_start + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY n)
                FILTER (WHERE own), '') AS mask
FROM p GROUP BY conv_id, speaker, part
"""
