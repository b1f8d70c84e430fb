"""Line dedup over overlapping windows of three consecutive lines.

Every window of three consecutive lines is hashed to 128 bits; windows that
occur more than once anywhere are found by a map-side aggregated count; every
occurrence but the first - first in order of (doc_id, position) - covers its
three lines, overlapping windows merge, and covered lines go. Windows are
judged on the input, not on what is left of it.

DataFrame functions only. The aggregate keeps one row per window and task
before the shuffle, so a passage found in a third of all documents costs no
reducer more than one row per map task; the join back from windows to repeated
keys is between two plain shuffles, which adaptive execution can split where
one key is hot. Kept positions come from ``array_except`` on the position
sequence (a hash set), so a document of a million lines stays linear.

Defined cases
    * null text: no lines, text stays null. Empty text: one empty line.
    * fewer than three lines: no window, nothing is removed.
    * a window of three empty lines is never a repeat.
    * null doc_id: the row is returned as it is and lends no windows.
    * rows that share a doc_id are the same document: a window at the same
      place in both is one occurrence, so neither removes the other, and what
      one loses the other loses at the same places.
    * extra columns are carried along by ``dedup_lines`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import materialize
from .common import fresh

SIZE = 3


def _windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(k1, k2, id, pos): every window of ``size`` lines that is not blank."""
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    lines = lines.where(F.size("lines") >= size)

    def key(seed: int, i: Column) -> Column:
        return F.xxhash64(F.lit(seed), *[F.get("lines", i + j) for j in range(size)])

    def window(i: Column) -> Column:
        blank = F.lit(True)
        for j in range(size):
            blank = blank & (F.get("lines", i + j) == "")
        return F.struct(key(3, i).alias("k1"), key(5, i).alias("k2"), i.alias("pos"), blank.alias("blank"))

    starts = F.sequence(F.lit(0), F.size("lines") - size)
    w = lines.select("id", F.explode(F.transform(starts, window)).alias("w")).select("id", "w.*")
    return w.where(~F.col("blank")).select("k1", "k2", "id", "pos")


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, pos) of every window that is not the first occurrence of its lines."""
    windows = _windows(docs, id_col, text_col, size)
    first = (windows.groupBy("k1", "k2")
             .agg(F.min(F.struct("id", "pos")).alias("first"), F.max(F.struct("id", "pos")).alias("last"))
             .where("first != last").select("k1", "k2", "first"))
    # written first: the join below is then between two plain shuffles
    first = materialize(first).df
    return (windows.join(first, ["k1", "k2"])
            .where(F.struct("id", "pos") != F.col("first")).select("id", "pos"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and two counts (None: no such column).

    Where ``docs`` has a column of a count's name, the count's own is lengthened by "_".
    """
    marks, lines, kept = (fresh(x, docs.columns) for x in ("__marks", "__lines", "__kept"))
    gone = (later_windows(docs, id_col, text_col, size).groupBy("id").agg(F.collect_list("pos").alias(marks))
            .withColumnRenamed("id", fresh("__id", docs.columns)))
    id_gone = gone.columns[0]
    joined = docs.join(gone, docs[id_col] == gone[id_gone], "left").drop(id_gone)
    split = F.split(F.col(text_col), "\n", -1)
    covered = F.flatten(F.transform(F.col(marks), lambda p: F.sequence(p, p + (size - 1))))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    out = (joined.withColumn(lines, F.when(F.col(text_col).isNotNull(), split))
           .withColumn(kept, F.when(F.col(marks).isNotNull(), F.array_except(every, covered))))
    text = F.when(F.col(kept).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(F.col(kept), lambda p: F.get(lines, p)), "\n"))
    total = F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long")
    cols = [text.alias(text_col) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns]
    if lines_col:
        lines_col = fresh(lines_col, docs.columns)
        cols.append(total.alias(lines_col))
    if removed_col:
        removed_col = fresh(removed_col, [*docs.columns, lines_col or ""])
        cols.append(F.when(F.col(kept).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
                    .alias(removed_col))
    return out.select(*cols)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; a document that lost all its lines goes, ``n_chars`` follows the text."""
    gone, total = fresh("__removed", docs.columns), fresh("__total", docs.columns)
    out = dedup_lines(docs, lines_col=total, removed_col=gone)
    out = out.where((F.col(gone) == 0) | (F.col(gone) < F.col(total)))
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                          .otherwise(F.col("n_chars"))).select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i AS pos, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS k
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM d WHERE len(lines) >= 3) t),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n
      FROM w WHERE k <> chr(10) || chr(10)),
c AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (VALUES (0), (1), (2)) v(o) WHERE n > 1),
l AS (SELECT doc_id, lines, i AS pos FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM d) t),
k AS (SELECT l.doc_id AS doc_id, string_agg(l.lines[l.pos + 1], chr(10) ORDER BY l.pos) AS text, count(*) AS kept
      FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos WHERE c.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id AS doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(d.lines), 0) - coalesce(k.kept, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
