"""BPE encoding and decoding with a priority queue of merge ranks.

A word is a doubly linked list of symbols. Every neighbouring pair that the
merge table knows waits in a heap under its rank (then its place); the least one
is merged, its new pairs with both neighbours join the heap, and entries whose
symbols have changed since are skipped when they come up. A word of n symbols
takes O(n log n), so very long words are no special case.

A text is cut at white space, which this kind of tokenizer drops, into units.
Added tokens are cut out of a unit first, the rest is normalised and split into
words by the tokenizer's own normaliser and pre-tokenizer, and each word is
encoded by the heap. White space is a border for all these steps, so the ids of
a text are those of its units, one after the other; a worker remembers the units
and words it met of late (two generations of at most ``MEMORY`` each). Documents are encoded where they lie: no shuffle.

Decoding joins the vocabulary strings of the ids by blanks, which is what a
tokenizer file without a decoder defines.

Defined cases
    * null and empty texts, and texts of white space only: no ids, decoded to the empty text.
    * symbols that are not in the vocabulary have the unknown token's id, or none if the file has none.
    * added tokens in a text have their own ids, even within a word.
    * repeated rows and null doc_ids: each row is encoded by itself.
    * very long texts and words are encoded whole.
    * an empty table gives no rows; extra columns are carried along by ``encode``
      (its own column names are lengthened if taken) and not looked at by the query.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, fresh

MEMORY = 300_000
LONG_UNIT = 200  # longer units and words are not remembered
BITS = 24  # of an id
# The normaliser and pre-tokenizer whose words of printable ASCII PLAIN_WORD finds in a lower-cased text.
PLAIN_NORMAL = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+").findall
#: These four split units for ``str.split``, but are no white space to the tokenizer.
SEPARATORS = re.compile(r"[\x1c-\x1f]").search


class Bpe:
    """A tokenizer file of the BPE kind: added tokens, normaliser, pre-tokenizer, vocabulary and merges."""

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model = spec["model"]
        # truncation, padding and the post-processor are not used
        library = Tokenizer.from_str(data)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.unknown = self.vocabulary.get(model["unk_token"]) if model.get("unk_token") else None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None
        self.string = {i: t for t, i in [*self.vocabulary.items(), *self.added.items()]}
        # pair of ids -> rank and merged id, each packed into one integer
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[self.vocabulary[a] << BITS | self.vocabulary[b]] = rank << BITS | self.vocabulary[a + b]
        # words of printable ASCII can be split here; other texts are left to the library
        self.plain = spec["pre_tokenizer"] == PLAIN_SPLIT and spec["normalizer"] == PLAIN_NORMAL
        self.words: dict[str, list[int]] = {}
        self.units: dict[str, tuple[int, str, str]] = {}
        self.older_words: dict[str, list[int]] = {}
        self.older_units: dict[str, tuple[int, str, str]] = {}

    def symbols(self, word: str) -> list[int]:
        get = self.vocabulary.get
        ids = [get(c, self.unknown) for c in word[:-1]]
        ids.append(get(word[-1] + self.end, self.unknown))
        return [i for i in ids if i is not None] if None in ids else ids

    def merge(self, ids: list[int]) -> list[int]:
        """Merge pairs by rising rank, equal ranks from left to right, until none is left."""
        n, get = len(ids), self.merges.get
        shift = n.bit_length()
        heap = [found << shift | at for at, (a, b) in enumerate(zip(ids, ids[1:])) if (found := get(a << BITS | b)) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        ids.append(-1)  # before the first and behind the last symbol: pairs with it are negative, so never merged
        before, after = list(range(-1, n)), list(range(1, n + 2))
        places, low = (1 << shift) - 1, (1 << BITS) - 1
        while heap:
            entry = heapq.heappop(heap)
            at = entry & places
            right = after[at]
            if get(ids[at] << BITS | ids[right]) != entry >> shift:
                continue  # one of its symbols has been merged meanwhile
            new = ids[at] = entry >> shift & low
            ids[right] = -1
            after[at] = beyond = after[right]
            before[beyond] = at
            if (found := get(new << BITS | ids[beyond])) is not None:
                heapq.heappush(heap, found << shift | at)
            left = before[at]
            if (found := get(ids[left] << BITS | new)) is not None:
                heapq.heappush(heap, found << shift | left)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older_words.get(word)
            if ids is None:
                ids = self.merge(self.symbols(word))
            if len(word) <= LONG_UNIT:
                if len(self.words) >= MEMORY:
                    self.older_words, self.words = self.words, {}
                self.words[word] = ids
        return ids

    def unit(self, unit: str) -> list[int]:
        """The ids of a text, whatever it holds."""
        out: list[int] = []
        for part in self.cut(unit) if self.cut else [unit]:
            if part in self.added:
                out.append(self.added[part])
            elif self.plain and part.isascii() and part.isprintable():
                for word in PLAIN_WORD(part.lower()):
                    out += self.word(word)
            elif part:
                for word, _ in self.split(self.normalise(part)):
                    out += self.word(word)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for u in self.cells(text) for i in map(int, u[1].split())]

    def cells(self, text: str | None) -> list[tuple[int, str, str]]:
        """Per unit of a text: the number of ids, the ids and their strings, both joined by blanks."""
        if not text:
            return []
        parts = re.split(r"[ \t\n\r]+", text) if SEPARATORS(text) else text.split()
        known = self.units
        out = list(map(known.get, parts))
        if None in out:
            for k, cell in enumerate(out):
                if cell is None:
                    out[k] = self.cell(parts[k])
        return [c for c in out if c[0]] if any(not c[0] for c in out) else out

    def cell(self, unit: str) -> tuple[int, str, str]:
        found = self.units.get(unit)
        if found is None:
            found = self.older_units.get(unit)
            if found is None:
                ids = self.unit(unit)
                found = len(ids), " ".join(map(str, ids)), self.decode(ids)
            if len(unit) <= LONG_UNIT:
                if len(self.units) >= MEMORY:  # keep what was met of late
                    self.older_units, self.units = self.units, {}
                self.units[unit] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ``ids``; ids that the file does not have are left out."""
        return " ".join([self.string[i] for i in ids if i in self.string])


_MODELS: dict[int, Bpe] = {}


def loaded(data: bytes) -> Bpe:
    """One model per worker process and file, with what it remembers, kept from task to task."""
    key = zlib.crc32(data)
    if key not in _MODELS:
        _MODELS[key] = Bpe(data.decode())
    return _MODELS[key]


# ------------------------------------------------------------------- on Spark

def encode(docs: DataFrame, path: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids and the decoded text; with ``digests`` their SHA-256 instead of the last two.

    ids are joined by blanks for the digest. ``path`` is read on the driver and sent to the workers.
    """
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = ({"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} if digests else
             {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string"})
    names, taken = [], list(docs.columns)
    for name in kinds:
        names.append(fresh(name, taken))
        taken.append(names[-1])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
                       + [f"`{n}` {k}" for n, k in zip(names, kinds.values())])
    at = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> dict:
        model = loaded(sent.value)
        cols: list[list] = [[], [], []]
        for text in batch.column(at):
            cells = model.cells(text.as_py())
            ids, decoded = " ".join([c[1] for c in cells]), " ".join([c[2] for c in cells])
            cols[0].append(sum([c[0] for c in cells]))
            cols[1].append(sha256(ids.encode()).hexdigest() if digests else [int(i) for i in ids.split()])
            cols[2].append(sha256(decoded.encode()).hexdigest() if digests else decoded)
        return {f.name: batch.column(k) for k, f in enumerate(docs_fields)} | dict(zip(names, cols))

    docs_fields = docs.schema.fields
    return arrow_rows(docs, schema, work)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True).drop("text")
