"""Ranked lexical search by bag deduplication.

Every document is scored against every item, but equal bags are scored once.
A document is restricted to the words of the items, which leaves a vector of
term counts; documents with the same vector and the same length norm ``m`` have
the same score for every item, so they form a class. Classes are grouped by two
64-bit hashes together with the vector itself: the hashes deal the rows, the
vector decides (Spark compares grouping keys byte by byte). Should two classes
share both hashes and ``m``, all are hashed anew with other seeds.

Each class is scored once, a batch of classes against all items through the
items' posting lists, and a task keeps the best ``k`` classes of each item. A
class is named by its least doc_id and ranks no better than that document, so
the best ``k`` classes of an item hold its best ``k`` documents. Only the classes
that won for some item are expanded, by ascending doc_id, up to ``k`` members:
a class can't have more of them among the best ``k``.

Items come in blocks whose texts have at most ``BLOCK_BYTES`` bytes (a single
item may be longer), each block a pass over the documents: what is sent to the
tasks (a block's vocabulary, postings and weights) is bounded, whatever the number of
items. Document statistics cover all documents; those per term are aggregated
before they are shuffled, and one number per vocabulary term returns to the driver.

Scores are 64-bit integers: sum over the item's terms, repeats included, of
w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 25 + (75 * n * N) div L.

Defined cases
    * null and empty texts have no term; such documents count nowhere and are not ranked.
    * items without a known term, or no document with a score above 0: no rows.
    * null item_id: the item is left out; rows that share an item_id are one
      item, that of the least text (null before others).
    * null doc_ids: counted like others, ranked after others of the same score;
      rows that share a doc_id are documents of their own.
    * an empty table of documents or of items gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import count
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import drop_materialized, materialize
from ..functions.topk import top_k_per_group
from .common import arrow_rows, cut, ship

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}
K = 10
BLOCK_BYTES = 8 << 20
CELLS = 1 << 21  # scores, or postings, that a task holds at a time
NO_ID = np.iinfo(np.int64).max  # sorts a null doc_id last


def term_counts(text: str | None) -> Counter:
    """The terms of a text, lower-cased in A-Z only, with their numbers."""
    raw = Counter(TERM.findall(text or ""))
    out: Counter = Counter()
    for term, n in raw.items():
        out[term.lower() if term.isascii() else term.translate(LOWER)] += n
    return out


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """A block of items: ids, vocabulary, and for each term the items that hold it."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        bags = [(i, term_counts(t)) for i, t in rows]
        bags = [(i, b) for i, b in bags if b]
        self.ids = [i for i, _ in bags]
        self.terms = {t: k for k, t in enumerate(sorted({t for _, b in bags for t in b}))}
        pairs = sorted((self.terms[t], k, n) for k, (_, b) in enumerate(bags) for t, n in b.items())
        term, item, n = (np.array(c, np.int64) for c in (zip(*pairs) if pairs else ([], [], [])))
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.item, self.times = item, n

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """rows x items: for each entry (row, term, value), value times the item's number of the term, summed."""
        out = np.zeros(rows * len(self.ids), np.int64)
        first, n = self.start[term], self.start[term + 1] - self.start[term]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):  # at most about CELLS postings at a time
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + CELLS, side="right")))
            m = n[lo:hi]
            at = np.repeat(first[lo:hi] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            np.add.at(out, np.repeat(row[lo:hi] * len(self.ids), m) + self.item[at], np.repeat(value[lo:hi], m) * self.times[at])
            lo = hi
        return out.reshape(rows, len(self.ids))


class Best:
    """The best ``k`` classes of each item so far: score falling, doc_id rising."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.rep = np.zeros((items, 0), np.int64), np.zeros((items, 0), np.int64)
        self.keys = np.zeros((items, 0, 3), np.int64)

    def add(self, scores: np.ndarray, rep: np.ndarray, keys: np.ndarray) -> None:
        """``scores`` is rows x items; rows are classes with ``rep`` and ``keys``."""
        score = np.concatenate([self.score, scores.T], axis=1)
        reps = np.concatenate([self.rep, np.broadcast_to(rep, scores.T.shape)], axis=1)
        order = np.lexsort((reps, -score), axis=1)[:, :self.k]
        old = self.score.shape[1]
        fresh = keys[np.maximum(order - old, 0)] if len(keys) else np.zeros((*order.shape, 3), np.int64)
        kept = np.take_along_axis(self.keys, np.minimum(order, max(old - 1, 0))[..., None], axis=1) if old else fresh
        self.keys = np.where((order < old)[..., None], kept, fresh)
        self.score, self.rep = np.take_along_axis(score, order, 1), np.take_along_axis(reps, order, 1)

    def rows(self) -> tuple[np.ndarray, ...]:
        item, place = np.nonzero(self.score > 0)
        return item, self.score[item, place], self.rep[item, place], self.keys[item, place]


# ------------------------------------------------------------------- on Spark

def bags_of(docs: DataFrame, vocabulary: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, bag): documents with a term; ``bag`` holds (term, tf) pairs as 32-bit integers by rising term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch: pa.RecordBatch) -> dict:
        known = sent.value
        ids, ns, out = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = term_counts(text.as_py())
            if counts:
                pairs = sorted((known[t], c) for t, c in counts.items() if t in known)
                ids.append(doc_id)
                ns.append(counts.total())
                out.append(np.array(pairs, "<u4").tobytes())
        return {"doc_id": ids, "n": ns, "bag": out}

    return arrow_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), "doc_id bigint, n bigint, bag binary", work)


def document_frequencies(bags: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term occurs: counted per task, then summed per term."""
    ship(bags.sparkSession.sparkContext)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            joined = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            total += np.bincount(joined[::2], minlength=terms)
        held = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(held, pa.int64()), "df": pa.array(total[held], pa.int64())})

    out = np.zeros(terms, np.int64)
    counted = bags.select("bag").mapInArrow(work, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in counted.toPandas().itertuples(index=False):  # at most one row per vocabulary term
        out[term] = df
    return out


def best_classes(classes: DataFrame, items: Items, weights: np.ndarray, k: int) -> DataFrame:
    """(item, score, rep, k1, k2, m): the best ``k`` classes of every item in each task."""
    sc = classes.sparkSession.sparkContext
    ship(sc)
    sent = sc.broadcast((items, weights))
    kinds = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("rep", pa.int64()), ("k1", pa.int64()),
                       ("k2", pa.int64()), ("m", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        best, most = Best(len(items.ids), k), max(1, CELLS // max(1, len(items.ids)))
        for batch in batches:
            for piece in cut(batch, 1_000_000):
                for lo in range(0, piece.num_rows, most):
                    part = piece.slice(lo, most)
                    data = part.column(0).to_pylist()
                    pairs = np.frombuffer(b"".join(data), "<u4").astype(np.int64)
                    term, tf = pairs[::2], pairs[1::2]
                    rep, k1, k2, m = (part.column(c).to_numpy(zero_copy_only=False) for c in range(1, 5))
                    row = np.repeat(np.arange(len(data)), [len(d) // 8 for d in data])
                    value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                    best.add(items.scores(row, term, value, len(data)), rep, np.stack([k1, k2, m], axis=1))
        item, score, rep, keys = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (item, score, rep, *keys.T)], schema=kinds)

    columns = ["bag", "rep", "k1", "k2", "m"]
    return classes.select(*columns).mapInArrow(work, "item bigint, score bigint, rep bigint, k1 bigint, k2 bigint, m bigint")


def bag_hashes(bag: Column, attempt: int) -> list[Column]:
    return [F.xxhash64(F.lit(23), F.lit(attempt), bag).alias("k1"), F.xxhash64(F.lit(89), F.lit(attempt), bag).alias("k2")]


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of at most ``most`` bytes of text, or one item."""
    block, held = [], 0
    for row in items.toLocalIterator():
        size = len((row["text"] or "").encode())
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += size
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES, hashes=bag_hashes) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents of each item."""
    single = (items.where(F.col(item_col).isNotNull()).groupBy(F.col(item_col).cast("long").alias("item_id"))
              .agg(F.min(F.struct(F.col(item_text).alias("text"))).alias("t")).select("item_id", "t.text"))
    found = None
    for block in item_blocks(single, block_bytes):
        part = _search_block(docs, Items(block), id_col, text_col, k, hashes)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found


def _search_block(docs: DataFrame, items: Items, id_col: str, text_col: str, k: int, hashes) -> DataFrame | None:
    spark = docs.sparkSession
    if not items.ids:
        return None
    raw = materialize(bags_of(docs, items.terms, id_col, text_col))
    n_docs, length = raw.df.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.array([weight(n_docs, int(df)) for df in document_frequencies(raw.df, len(items.terms))], np.int64)
    rep = F.coalesce(F.min("doc_id"), F.lit(int(NO_ID))).alias("rep")
    names = ["k1", "k2", "m"]
    for attempt in count():
        keyed = raw.df.where(F.length("bag") > 0).select(
            "doc_id", "bag", *hashes(F.col("bag"), attempt), F.expr(f"100 - 75 + ((75 * n * {n_docs}L) div {length}L)").alias("m"))
        classes = materialize(keyed.groupBy(*names, "bag").agg(rep))
        # the two hashes and m must name one class each; else all bags are hashed anew
        if classes.df.select(*names).distinct().count() == classes.df.count():
            break
        drop_materialized(spark, [classes])
    near = best_classes(classes.df, items, weights, k)
    order = [F.col("score").desc(), F.col("rep")]
    won = materialize(top_k_per_group(near, ["item"], order, k))
    wanted = F.broadcast(won.df.select(*names).distinct())  # at most k narrow rows per item of the block
    members = top_k_per_group(keyed.select(*names, "doc_id").join(wanted, names), names,
                              [F.col("doc_id").asc_nulls_last()], k, rank_col="nth").drop("nth")
    ranked = top_k_per_group(won.df.select("item", "score", *names).join(members, names), ["item"],
                             [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, rank_col="rank")
    ids = F.broadcast(spark.createDataFrame(list(enumerate(items.ids)), "item bigint, item_id bigint"))
    out = materialize(ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    drop_materialized(spark, [raw, classes, won])
    return out.df


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
i AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, c GROUP BY term, n_docs),
s AS (
    SELECT q.item_id, tf.r, CAST(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * len(d.terms) * c.n_docs) // c.l))))
                                 AS BIGINT) AS score
    FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN d ON d.r = tf.r, c
    GROUP BY q.item_id, tf.r
),
k AS (
    SELECT s.item_id, d.doc_id, s.score,
           row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id ASC NULLS LAST) AS n
    FROM s JOIN d ON d.r = s.r WHERE s.score > 0
)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM k WHERE n <= 10
"""
