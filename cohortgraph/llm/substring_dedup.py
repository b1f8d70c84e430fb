"""Substring dedup: matching statistics against suffix automata of reference shards.

A word is removed if a window of ``WINDOW`` consecutive words that covers it also
starts in a document with a smaller doc_id. Windows are judged on the input.

Streaming every document through an automaton of every other document would
grow with the square of the corpus, so exact filters first find who can match
whom; they may let too much through, never too little:

1. Later copies of a whole text collapse onto the first (by a 128-bit key).
2. Winnowing: of the ``WINDOW - GRAM + 1`` hashed word GRAM-grams in a window the least is its
   anchor; equal windows have equal anchors. Anchors are counted over all
   documents, and those found twice set bits in a bitmap of fixed size, which is
   broadcast. When the corpus outgrows the bitmap more windows pass it.
3. Runs of windows whose anchor's bit is set are the candidate passages (words
   and place). Their windows' 128-bit hashes give the first document of each window and
   so the routes (passage, reference document); passages that hold a first
   occurrence are the reference passages.
4. Reference documents are dealt into shards of about ``SHARD_WORDS`` candidate
   words. A shard's generalised suffix automaton is built over words, in
   ascending doc_id, and keeps the first document of every state. It goes to all
   tasks that hold passages routed to the shard; a shard many documents refer
   to is split over several tasks.
5. A passage is streamed through the automaton. Its matching statistic at each
   word is the longest match that ends there; where it reaches ``WINDOW``, the state
   of the window's length tells the first document that has it. Covered words
   merge into maximal spans.
6. Documents with spans lose them; all others keep their text.

All words are compared as words; hashes only choose candidates. No automaton is
broadcast: a shard's reference passages and the passages routed to it meet in a
group of their own, and whole documents are not streamed.

Defined cases
    * null and empty texts have no words; fewer than ``WINDOW`` words: nothing removed.
    * null doc_id: the row keeps all words and lends no windows.
    * rows that share a doc_id never remove each other's words.
    * repeats inside one document are no reason to remove anything.
    * extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import materialize
from .common import WORD, arrow_rows, hash_words, mix64, ngram_hashes, ship, text_key

WINDOW, GRAM = 13, 5
BITMAP_BITS = 27  # 16 MB
SHARD_WORDS, TASK_WORDS = 60_000, 400_000
BROADCAST_ROWS = 1_000_000
SECOND = np.uint64(0x5851F42D4C957F2D)  # sets the second hash of a window apart from the first
SEGMENT = 1 << 16  # bits of the bitmap that are gathered in one row


# ------------------------------------------------------------ words and anchors

def hashed_words(texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray]]:
    words = [WORD.findall(t) if t else [] for t in texts]
    every, ends = hash_words([w for ws in words for w in ws]), np.cumsum([len(ws) for ws in words])
    return words, np.split(every, ends[:-1]) if words else []


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window: the least of its gram hashes, spread over 64 bits again."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    low, have, need = ngram_hashes(hashes, gram), 1, window - gram + 1
    while have < need:
        more = min(have, need - have)
        low = np.minimum(low[:-more], low[more:])
        have += more
    return mix64(low + np.uint64(1))


def bit_of(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


# ----------------------------------------------------------- the suffix automaton

class Automaton:
    """A generalised suffix automaton over words; documents must be added in ascending doc_id."""

    def __init__(self, window: int):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.holder: list[int] = []

    def add(self, words: list[str], doc_id: int) -> None:
        next_, link, length, number = self.next, self.link, self.length, self.number
        last = 0
        for w in words:
            c = number.setdefault(w, len(number))
            known = next_[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._clone(last, known, c)
                continue
            new = self._state({}, length[last] + 1, 0, doc_id)
            p = last
            while p >= 0 and c not in next_[p]:
                next_[p][c] = new
                p = link[p]
            if p >= 0:
                q = next_[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def _state(self, to: dict[int, int], length: int, link: int, first: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        """The part of state ``q`` with the strings up to one word longer than ``p``'s."""
        next_, link = self.next, self.link
        clone = self._state(dict(next_[q]), self.length[p] + 1, link[q], self.first[q])
        while p >= 0 and next_[p].get(c) == q:
            next_[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def finish(self) -> None:
        """For each state, the first document that has the window its strings end with (-1: too short)."""
        order = np.argsort(self.length, kind="stable").tolist()
        w, length, link = self.window, self.length, self.link
        self.holder = [-1] * len(link)
        for s in order:
            if length[s] >= w:
                above = link[s]
                self.holder[s] = self.holder[above] if length[above] >= w else self.first[s]

    def spans(self, words: list[str], doc_id: int) -> list[tuple[int, int]]:
        """Maximal spans of words in windows that an earlier document has."""
        next_, link, length, holder, window = self.next, self.link, self.length, self.holder, self.window
        number, out = self.number.get, []
        state = match = 0
        for at, word in enumerate(words):
            c = number(word)
            if c is None:
                state = match = 0
                continue
            while (to := next_[state].get(c)) is None:
                state = link[state]
                if state < 0:
                    break
                match = length[state]
            if to is None:
                state = match = 0
                continue
            state, match = to, match + 1
            if match >= window and holder[state] < doc_id:
                start = at + 1 - window
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], at + 1)
                else:
                    out.append((start, at + 1))
        return out


# ------------------------------------------------------------------- on Spark

def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row; spans are (start, end) in words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *text_key(F.col(text_col)))
    keys = materialize(rows.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("last"))
                       .where("of < last").select("k1", "k2", "of"))
    copy = rows.join(_small(keys), ["k1", "k2"], "left").withColumn("copy", F.coalesce(F.col("of") < F.col("doc_id"), F.lit(False)))
    copy = copy.select("doc_id", "text", "k1", "copy")

    found = _passages(copy, _bitmap(copy, window), window)
    spans = materialize(_match(found, window).groupBy("doc_id", "k1").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    # the ids are sent, not the spans: texts without spans stay where they are
    named = _small(replace(spans, df=spans.df.select("doc_id", "k1")))
    texts = rows.select("doc_id", "k1", "text").join(named, ["doc_id", "k1"], "left_semi")
    cut = materialize(_cut(texts.join(spans.df, ["doc_id", "k1"])).dropDuplicates(["doc_id", "k1"]))
    whole = found.select("doc_id", "k1", "n_words", "sha256", "copy")
    gone = F.col("copy") & (F.col("n_words") >= window)  # an earlier copy has all its windows
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(cut.df, ["doc_id", "k1"], "left").select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))))
        .otherwise(F.coalesce("merged", F.array().cast("array<struct<start: int, end: int>>"))).alias("spans"))


def _small(table) -> DataFrame:
    """Broadcast a counted table of a few numbers a row if it has few rows; else the join shuffles."""
    return F.broadcast(table.df) if table.rows <= BROADCAST_ROWS else table.df


def _bitmap(rows: DataFrame, window: int):
    """The broadcast bitmap of anchors that occur in two documents or more."""
    def work(batch):
        ids, out, owner = batch.column(0).to_pylist(), [], []
        for doc_id, h in zip(ids, hashed_words(batch.column(1).to_pylist())[1]):
            a = np.unique(anchors(h, window))
            out.append(a)
            owner.append(np.full(len(a), doc_id, np.int64))
        return {"anchor": np.concatenate(out).view(np.int64), "doc_id": np.concatenate(owner)}

    source = rows.where("not copy and doc_id is not null").select("doc_id", "text")
    twice = (arrow_rows(source, "anchor bigint, doc_id bigint", work).groupBy("anchor")
             .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"))
    bit = F.shiftrightunsigned("anchor", 64 - BITMAP_BITS)
    bits = twice.select((bit / SEGMENT).cast("int").alias("segment"), (bit % SEGMENT).cast("int").alias("bit"))
    # at most 2 ** BITMAP_BITS / SEGMENT rows of at most SEGMENT small numbers
    rows_ = materialize(bits.groupBy("segment").agg(F.collect_set("bit").alias("bits"))).df
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows_.toLocalIterator():
        one = np.zeros(SEGMENT, np.uint8)
        one[r["bits"]] = 1
        bitmap[r["segment"] * SEGMENT // 8:(r["segment"] + 1) * SEGMENT // 8] = np.packbits(one)
    return rows.sparkSession.sparkContext.broadcast(bitmap)


PASSAGES = "array<struct<start: int, text: string, one: array<bigint>, two: array<bigint>>>"


def _passages(rows: DataFrame, bitmap, window: int) -> DataFrame:
    """Of every row: n_words, sha256 of its words, and its candidate passages with their windows' hashes."""
    def work(batch):
        texts = batch.column(1).to_pylist()
        copies = batch.column(3).to_pylist()
        ids = batch.column(0).to_pylist()
        out = {"n_words": [], "sha256": [], "passages": []}
        for words, h, copied, doc_id in zip(*hashed_words(texts), copies, ids):
            runs = []
            if not copied and doc_id is not None and len(words) >= window:
                bit = bit_of(anchors(h, window))
                on = (bitmap.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
                edge = np.flatnonzero(np.diff(on, prepend=False, append=False))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    part = h[a:b + window - 1]
                    runs.append({"start": a, "text": " ".join(words[a:b + window - 1]),
                                 "one": ngram_hashes(part, window).view(np.int64),
                                 "two": ngram_hashes(mix64(part ^ SECOND), window).view(np.int64)})
            out["n_words"].append(len(words))
            out["sha256"].append(hashlib.sha256(" ".join(words).encode()).hexdigest())
            out["passages"].append(runs)
        return {"doc_id": batch.column(0), "k1": batch.column(2), "copy": batch.column(3), **out}

    return materialize(arrow_rows(
        rows.select("doc_id", "text", "k1", "copy"),
        f"doc_id bigint, k1 bigint, copy boolean, n_words bigint, sha256 string, passages {PASSAGES}", work)).df


def _match(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, k1, spans): what each shard's automaton says about the passages routed to it."""
    passages = found.select("doc_id", "k1", F.explode("passages").alias("p")).select("doc_id", "k1", "p.*")
    windows = passages.select(F.explode(F.arrays_zip("one", "two")).alias("w"), "doc_id", "start").select("w.*", "doc_id", "start")
    first = materialize(windows.groupBy("one", "two").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"))
                        .where("ref < last").select("one", "two", "ref")).df
    routes = materialize(windows.join(first, ["one", "two"]).select("doc_id", "start", "ref").distinct()).df
    texts = passages.select("doc_id", "k1", "start", "text", (F.length("text") / 6.5).alias("words"))  # about a word
    # the words of passages that hold a first occurrence
    total = (routes.where("ref = doc_id").join(texts, ["doc_id", "start"]).agg(F.sum("words")).first()[0] or 0)
    shards = max(1, int(total // SHARD_WORDS))
    to = routes.select("doc_id", "start", (F.col("ref") == F.col("doc_id")).alias("is_ref"),
                       F.pmod(F.xxhash64(F.lit(29), "ref"), F.lit(shards)).alias("shard")).distinct()
    routed = materialize(to.join(texts, ["doc_id", "start"])).df
    # as many tasks for a shard as its passages need; each of them gets the shard's reference passages
    load = materialize(routed.where("not is_ref").groupBy("shard").agg(
        F.ceil(F.sum("words") / TASK_WORDS).cast("int").alias("parts"))).df
    routed = routed.join(load, "shard")
    kept = routed.where("is_ref").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = routed.where("not is_ref").withColumn("part", F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.col("parts")).cast("int"))
    columns = ["shard", "part", "is_ref", "doc_id", "k1", "start", "text"]
    both = kept.select(*columns).union(asked.select(*columns))
    ship(found.sparkSession.sparkContext)
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def work(table: pa.Table) -> pa.Table:
        is_ref = np.array(table.column("is_ref").to_pylist(), bool)
        refs_ = table.filter(pa.array(is_ref)).sort_by([("doc_id", "ascending"), ("k1", "ascending"), ("start", "ascending")])
        automaton = Automaton(window)
        for doc_id, text in zip(refs_.column("doc_id").to_pylist(), refs_.column("text").to_pylist()):
            automaton.add(text.split(" "), doc_id)
        automaton.finish()
        out: dict[str, list] = {"doc_id": [], "k1": [], "spans": []}
        asked_ = table.filter(pa.array(~is_ref))
        for doc_id, k1, start, text in zip(*(asked_.column(c).to_pylist() for c in ("doc_id", "k1", "start", "text"))):
            spans = [{"start": start + a, "end": start + b} for a, b in automaton.spans(text.split(" "), doc_id)]
            if spans:
                out["doc_id"].append(doc_id)
                out["k1"].append(k1)
                out["spans"].append(spans)
        return pa.table(out, schema=schema)

    return both.groupBy("shard", "part").applyInArrow(
        work, "doc_id bigint, k1 bigint, spans array<struct<start: int, end: int>>")


def _cut(rows: DataFrame) -> DataFrame:
    """(doc_id, k1, n_removed, kept_sha256, merged) of rows with their spans."""
    def work(batch):
        out = {"n_removed": [], "kept_sha256": [], "merged": []}
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            merged: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(dict(s))
            words, kept, at = WORD.findall(text), [], 0
            for s in merged:
                kept += words[at:s["start"]]
                at = s["end"]
            kept += words[at:]
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
            out["merged"].append(merged)
        return {"doc_id": batch.column(0), "k1": batch.column(1), **out}

    return arrow_rows(rows.select("doc_id", "k1", "text", "spans"),
                      "doc_id bigint, k1 bigint, n_removed bigint, kept_sha256 string, merged array<struct<start: int, end: int>>", work)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13) t),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM g),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM f, range(0, 13) t(o) WHERE low < doc_id),
p AS (SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d) t),
k AS (SELECT p.doc_id AS doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.i) AS kept
      FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i WHERE c.doc_id IS NULL GROUP BY p.doc_id)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
