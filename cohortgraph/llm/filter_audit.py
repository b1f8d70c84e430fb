"""Filter interaction audit with count-weighted decision diagrams.

What a chain of filters removes depends on their order. Each document is
reduced to its failure mask (one bit per filter); Spark counts the documents of
each part per mask, with how many of them are labelled good or toxic. These
counts, at most 2 ** filters rows a part whatever its size, are the leaves of
one decision diagram per part: a level per filter, an edge for passing and one
for failing, equal subgraphs stored once, and at each node the counts of all
documents below it. The path that always passes is what a chain keeps: the
count below its node after k steps is kept, the count on the failing edge is
removed. All orders are reached from the first by swapping two neighbouring
levels at a time, which rebuilds these two levels only.

Identical texts are found by 128 bits of the text. Rows are counted per text
and class before they are dealt by text, so a text that a third of all rows
share is a few rows per task.

Defined cases
    * null texts are empty texts; an empty text has no words: A fails, B, C and D don't.
    * null part values are the empty string.
    * null doc_ids: no id is smaller than null and null is smaller than none,
      so E never holds for them; they have no label.
    * rows that share a doc_id and a text don't make each other fail E.
    * a doc_id with several label rows is good (toxic) if any of them says so.
    * an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, text_key

STOPS = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Counts = tuple[int, int, int]  # documents, good ones, toxic ones


# ------------------------------------------------------------ decision diagrams

class Diagram:
    """Levels of nodes (passing child, failing child) over leaves of counts, with equal nodes shared.

    A child is a position in the next level; below the last level it is a
    position in ``leaves``. Every path has all levels, so that counts add up.
    """

    def __init__(self, variables: Sequence[str], counts: dict[int, Counts]):
        self.order = list(variables)
        self.leaves = sorted(set(counts.values()) | {(0, 0, 0)})
        place = {leaf: k for k, leaf in enumerate(self.leaves)}
        n = len(self.order)
        below = [place[counts.get(mask, (0, 0, 0))] for mask in range(1 << n)]
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for level in reversed(range(n)):  # bit ``level`` of a mask is the variable of that level
            half = len(below) // 2
            below = self._store(level, [(below[m], below[m + half]) for m in range(half)])
        self._weigh(n - 1)

    def _store(self, level: int, nodes: Sequence[tuple[int, int]]) -> list[int]:
        """Put ``nodes`` in a level, equal ones once; the place of each."""
        seen: dict[tuple[int, int], int] = {}
        places = [seen.setdefault(node, len(seen)) for node in nodes]
        self.levels[level] = list(seen)
        return places

    def _weigh(self, last: int) -> None:
        """Counts below the nodes of the levels up to ``last`` (those beneath are known)."""
        if not hasattr(self, "weights"):
            self.weights: list[list[Counts]] = [[] for _ in self.levels] + [self.leaves]
        for level in range(last, -1, -1):
            beneath = self.weights[level + 1]
            self.weights[level] = [tuple(map(sum, zip(beneath[a], beneath[b]))) for a, b in self.levels[level]]

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next one; all other levels stay."""
        beneath = self.levels[level + 1]
        pairs = [(beneath[a], beneath[b]) for a, b in self.levels[level]]
        # (pass, fail) children by both variables, regrouped by the other variable first
        lower = [node for (pp, pf), (fp, ff) in pairs for node in ((pp, fp), (pf, ff))]
        places = self._store(level + 1, lower)
        upper = list(zip(places[0::2], places[1::2]))
        # no two nodes of a level are equal, so none of the regrouped ones are: their places stay
        self.levels[level] = upper
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        beneath_weights = self.weights[level + 2]
        self.weights[level + 1] = [tuple(map(sum, zip(beneath_weights[a], beneath_weights[b])))
                                   for a, b in self.levels[level + 1]]

    def steps(self) -> list[tuple[Counts, Counts]]:
        """(kept, removed) after each filter of the present order: the path that always passes."""
        out, node = [], 0
        for level, nodes in enumerate(self.levels):
            passed, failed = nodes[node]
            out.append((self.weights[level + 1][passed], self.weights[level + 1][failed]))
            node = passed
        return out


def adjacent_orders(n: int) -> Iterator[int]:
    """Levels to swap with the next one so that all orders of ``n`` variables are met (plain changes)."""
    if n < 2:
        return
    inner, down = adjacent_orders(n - 1), True
    while True:
        yield from reversed(range(n - 1)) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the moving variable stands first after a way down
        down = not down


def audit_counts(variables: str, counts: dict[int, Counts]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    diagram = Diagram(variables, counts)
    bit = {v: 1 << k for k, v in enumerate(variables)}
    fails = {v: sum(c[0] for mask, c in counts.items() if mask & b) for v, b in bit.items()}
    alone = {v: counts.get(b, (0, 0, 0))[0] for v, b in bit.items()}
    removed_in_all = dict.fromkeys(variables, 0)
    rows = []

    def read() -> None:
        for k, (v, (kept, removed)) in enumerate(zip(diagram.order, diagram.steps()), 1):
            removed_in_all[v] += removed[0]
            rows.append(("".join(diagram.order), k, kept[0], removed[0], fails[v] - removed[0], alone[v],
                         removed[1], removed[2]))

    read()
    for level in adjacent_orders(len(variables)):
        diagram.swap(level)
        read()
    return [(*row, removed_in_all[row[0][row[1] - 1]]) for row in rows]


# ------------------------------------------------------------------- on Spark

def conditions(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text (not null)."""
    words = F.filter(F.split(text, STOPS), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, LETTERS, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def class_counts(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by failure mask, E being bit 4."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions(F.col("text")).values())]
    masks = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                         text.alias("text"))
             .select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), *text_key(F.col("text"))))
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    none = F.lit(0)
    known = masks.where("doc_id is not null").join(marks, "doc_id", "left").select(
        "doc_id", "part", "mask", "k1", "k2", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    nameless = masks.where("doc_id is null").select("doc_id", "part", "mask", "k1", "k2", none.alias("good"), none.alias("toxic"))
    keys = ["k1", "k2", "part", "mask", "good", "toxic"]
    # rows of one document first: how many of a class have its least doc_id
    same = known.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    classes = same.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    # classes of one text: at most four a part and not more than the text's rows
    least = F.min("first.doc_id").over(Window.partitionBy("k1", "k2"))
    new = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0))
    split = classes.withColumn("new", new).select("part", "mask", "good", "toxic", F.inline(F.array(
        F.struct(F.lit(0).alias("again"), F.col("new").alias("n")),
        F.struct(F.lit(16).alias("again"), (F.col("n") - F.col("new")).alias("n")))))
    plain = nameless.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    rows = split.select("part", (F.col("mask") + F.col("again")).alias("mask"), "good", "toxic", "n").union(
        plain.select("part", "mask", "good", "toxic", "n"))
    return rows.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


OUT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
       "good_lost bigint, toxic_lost bigint, shapley bigint")


def audit(counted: DataFrame, variables: str = "ABCDE") -> DataFrame:
    """One row per part, order and step from (part, mask, n, good, toxic)."""
    ship(counted.sparkSession.sparkContext)
    kinds = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
             *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = audit_counts(variables, {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows})
        columns = zip(*[(rows[0]["part"], *f) for f in found])
        return pa.table([pa.array(c, type=k) for c, (_, k) in zip(columns, kinds)], schema=pa.schema(kinds))

    return counted.select("part", "mask", "n", "good", "toxic").groupBy("part").applyInArrow(work, OUT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(class_counts(docs, labels))


ORACLE = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
),
w AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
           min(doc_id) OVER (PARTITION BY text) AS least
    FROM t
),
m AS (
    SELECT part, doc_id,
           CAST(len(words) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER)
             + 4 * CAST(100 * capitals > 10 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
             + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS f,
           doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) IS TRUE AS good,
           doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) IS TRUE AS toxic
    FROM w
),
c AS (
    SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f
),
o(p) AS (
    SELECT '' UNION ALL
    SELECT p || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(p, x)
),
s AS (
    SELECT p AS filter_order, k AS step,
           sum(CASE WHEN j < k THEN 1 << (ascii(substr(p, j, 1)) - 65) ELSE 0 END) AS before,
           max(CASE WHEN j = k THEN 1 << (ascii(substr(p, j, 1)) - 65) END) AS v
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k), (SELECT unnest([1, 2, 3, 4, 5]) AS j) WHERE length(p) = 5 GROUP BY p, k
),
r AS (
    SELECT part, filter_order, step, v, n, good, toxic, (f & v) <> 0 AS fails, (f & CAST(before AS INTEGER)) <> 0 AS gone,
           f = v AS only_this
    FROM s, c
),
a AS (
    SELECT part, filter_order, step, v,
           sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM r GROUP BY part, filter_order, step, v
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, v) AS BIGINT) AS shapley
FROM a
"""
