"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

An item of m characters with an error budget of k = floor(m * rate) edits is
split into k + 1 pieces. Whatever k edits do, one piece survives unchanged, so
an exact search for all pieces (one Aho-Corasick automaton) finds every place
where the item can occur. Around each hit the item is verified: Myers' bit
vectors give the least edit distance between the item and any substring of
the window, in one pass over the window's characters. Both sides are compared
in lower case with runs of white space as one blank.

The automaton is broadcast. Its size is bounded by ``block_chars``: a larger
benchmark is dealt into blocks by item_id, and the documents are read once per
block. Documents are never shuffled with one block.

Defined cases
    * null or empty documents and items match nothing.
    * items shorter than ``min_chars`` after normalisation have no error budget and
      must stand between word borders, so that a short answer is found where it
      is a word of its own and not inside other words.
    * rows that share a doc_id are judged row by row; the same item twice in
      the benchmark is reported once per row; an item without id has a null id.
    * ties: the leftmost end with the least distance is reported.
    * extra columns are not looked at (``find_leaks``) or kept (``clean``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fresh

RATE = 0.06
MIN_CHARS = 24
BLOCK_CHARS = 8_000_000
LEAKS = "array<struct<item_id: bigint, distance: int, end: int>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces (offset, text) of near-equal length that make up the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance, its first end) of a pattern against the substrings of ``text``.

    Bit i of the vertical vectors tells whether row i + 1 of the distance
    matrix is one more (pv) or one less (nv) than row i, in the current column.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, nv, score = full, 0, m
    best, at = m, 0
    for j, ch in enumerate(text):
        eq = pattern_bits.get(ch, 0)
        d0 = (((eq & pv) + pv) ^ pv) | eq | nv
        hp = nv | ~(d0 | pv) & full
        hn = pv & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
            if score < best:
                best, at = score, j + 1
        hp = (hp << 1) & full  # row 0 is free: an occurrence may start anywhere
        hn = (hn << 1) & full
        pv = hn | ~(d0 | hp) & full
        nv = hp & d0
    return best, at


class Matcher:
    """The pieces of a block of items, ready to search documents."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        import ahocorasick

        self.items: list[tuple[int, str, int, dict[str, int], bool]] = []
        of: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normal(text)
            if not item:
                continue
            short = len(item) < min_chars
            budget, bits = 0 if short else int(len(item) * rate), {}
            for i, ch in enumerate(item):
                bits[ch] = bits.get(ch, 0) | 1 << i
            for offset, piece in pieces(item, budget):
                of.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, item, budget, bits, short))
        self.automaton = ahocorasick.Automaton()
        for piece, where in of.items():
            self.automaton.add_word(piece, (len(piece), where))
        if of:
            self.automaton.make_automaton()

    def leaks(self, text: str | None) -> list[dict]:
        if not text or not self.items:
            return []
        doc = normal(text)
        hits: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton.iter(doc):
            for k, offset in where:
                hits.setdefault(k, []).append(end + 1 - length - offset)
        found = []
        for k, starts in hits.items():
            item_id, item, budget, bits, short = self.items[k]
            best = None
            if short:  # one piece, the whole item: the hits are its occurrences
                at = next((s for s in starts if self.stands_alone(doc, s, s + len(item))), None)
                if at is not None:
                    found.append({"item_id": item_id, "distance": 0, "end": at + len(item)})
                continue
            for a, b in self.spans(starts, len(item), budget, len(doc)):
                distance, end = myers(bits, len(item), doc[a:b])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, a + end)
            if best:
                found.append({"item_id": item_id, "distance": best[0], "end": best[1]})
        return sorted(found, key=lambda x: (x["item_id"] is None, x["item_id"] or 0))

    @staticmethod
    def stands_alone(doc: str, start: int, end: int) -> bool:
        """Whether no word goes on across either end of a part of ``doc``."""
        before = start > 0 and doc[start - 1].isalnum() and doc[start].isalnum()
        after = end < len(doc) and doc[end - 1].isalnum() and doc[end].isalnum()
        return not before and not after

    @staticmethod
    def spans(starts: list[int], m: int, budget: int, length: int):
        """Merged windows around the expected starts; each holds every occurrence near its hits."""
        a = b = None
        for s in sorted(set(starts)):
            lo, hi = max(0, s - budget), min(length, s + m + budget)
            if b is not None and lo <= b:
                b = max(b, hi)
                continue
            if b is not None:
                yield a, b
            a, b = lo, hi
        if b is not None:
            yield a, b


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, leaks): the benchmark items found in each row, ordered by item_id."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    leaks = fresh("leaks", [id_col, *keep])
    columns = list(dict.fromkeys([id_col, *keep]))
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text_col])])
    for block in range(n_blocks):
        # at most about block_chars of text: a bounded share of the benchmark
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        sent = spark.sparkContext.broadcast([tuple(r) for r in mine.orderBy("item_id", "text").collect()])
        rows = _search(rows, text_col, fresh(f"__leaks{block}", rows.columns), sent, rate, min_chars)
    parts = rows.columns[-n_blocks:]
    found = F.concat(*[F.col(p) for p in parts]) if n_blocks > 1 else F.col(parts[0])
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.array_sort(found).alias(leaks))


def _search(rows: DataFrame, text_col: str, out_col: str, sent, rate: float, min_chars: int) -> DataFrame:
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out_col}` {LEAKS}"
    matchers: dict[int, Matcher] = {}

    def work(batch):
        if 0 not in matchers:
            matchers[0] = Matcher(sent.value, rate, min_chars)
        texts = batch.column(names.index(text_col)).to_pylist()
        return {**{n: batch.column(i) for i, n in enumerate(names)}, out_col: [matchers[0].leaks(t) for t in texts]}

    return arrow_rows(rows, schema, work)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per document: whether it holds a benchmark item, which, and the least distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("leaked"), F.col("leaks.item_id").alias("item_ids"),
                        F.array_min("leaks.distance").alias("distance"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return found.where(F.size(found.columns[-1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
