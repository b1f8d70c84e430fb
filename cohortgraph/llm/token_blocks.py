"""Token-ID output in binary blocks coded by an adaptive range coder.

Documents are range-partitioned by doc_id and sorted within each partition; a
task encodes its documents, appends the end id to each, and writes frames: a
frame holds whole documents, at least ``FRAME_IDS`` ids of them (a document longer than
that is a frame by itself), cut into blocks of at most ``BLOCK_IDS`` ids. Blocks are
coded independently (``rangecoder``) and carry checksums of the ids and of
their bytes, so damage is found and stays within a block.

Frames are the rows of a Parquet table written by Spark, so files commit
atomically, a lost executor only repeats its tasks, and any store works that
Spark can write to. Reading decodes the frames where they lie; the only
shuffle in the whole way is the sort by doc_id.

Frame layout (little-endian): magic "IDS2", vocabulary u32, documents u32, ids
u64, ids of the partition's frames before it u64; per document: doc_id i64, 1 byte
(0 where doc_id is null), ids u32; crc32 of all before it; then the blocks.

Encoding uses the tokenizers library. Its pre-tokenizer never joins characters
over a blank between two words, so a text is the concatenation of its
blank-delimited units, and ids of units met before are remembered (a bounded
memory; when it is full, units that were not met again are forgotten). A line feed
that touches no other white space divides units as well. Arrow cuts the texts of a
batch and numbers their different units; new ones are cut at borders between
letters, digits and punctuation, so that the library encodes a word once, whatever
follows it. Texts where blanks touch other white space are split by the
pre-tokenizer's own pattern instead.

Defined cases
    * null and empty texts: the end id only.
    * null doc_ids come first; rows with equal doc_ids are ordered by a hash
      of their text and take consecutive places.
    * very long texts: one frame of many blocks.
    * strings of added tokens in a text have the token's id, as by the library's
      default; such a text, and one with the control character 1, is encoded whole,
      without the memory.
    * an empty table writes no frame and reads as no rows; extra columns are
      not looked at.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import arrow_rows, cut, ship
from .rangecoder import decode_block, encode_block

END_ID = 2
FRAME_IDS = BLOCK_IDS = 1 << 21
FRAME = struct.Struct("<4sIIQQ")
PIECE = 10_000_000  # bytes of text encoded together
UNITS, UNIT_BYTES = 800_000, 100_000_000  # most units, and bytes of them and their ids, before those not met again are forgotten
# Fixed value: the pre-tokenizer's pattern, which must be the tokenizer's own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space of any Unicode version.
SPACE = "\t-\r\x1c- \x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Characters that are letters, or ASCII punctuation, in every Unicode version. The pattern always parts runs of
# these and of digits, but for letters after an apostrophe, and a line feed at the start of a unit from what follows.
_L, _P = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{481}\x{4e00}-\x{9fa5}", r"!-&(-/:-@\[-`{-~"
WORD = f"^ ?[{_L}]+$"
BORDERS = f"([{_L}])([{_P}0-9])", f"([0-9])([{_P}{_L}])", f"([{_P}])([{_L}0-9])", f"^(\n)([{_P}{_L}0-9])"
MARK = "\x01"  # set where texts and units are cut; a text that holds it is encoded whole
TOGETHER = 100  # words that the library gets at once


# ------------------------------------------------------------------ text to ids

class Ids:
    """Ids of many units, one after another."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.sizes = data, sizes
        self.starts = np.cumsum(sizes) - sizes

    def __add__(self, other: Ids) -> Ids:
        return Ids(np.concatenate([self.data, other.data]), np.concatenate([self.sizes, other.sizes]))

    def of(self, numbers: np.ndarray) -> Ids:
        """Those of the units ``numbers``."""
        n = self.sizes.take(numbers)
        at = np.repeat(self.starts.take(numbers) - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        return Ids(self.data.take(at), n)


def _holds(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


class Encoder:
    """Ids of texts, remembering those of the units met before.

    Strings of added tokens are ordinary text with ``added_as_text``, and else
    have the token's id, the library's default.
    """

    def __init__(self, path: str, added_as_text: bool = True):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        self.added = [] if added_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # for words of letters, one a line: needs no pattern
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.split = regex.compile(PATTERN).findall
        self.forget(np.zeros(0, np.int64))

    # the units met before, their ids one after another, and which units were met again

    def forget(self, kept: np.ndarray) -> None:
        """Remember the units ``kept`` only."""
        if len(kept):
            units, ids = self.units.take(pa.array(kept)), self.ids.of(kept)
        else:
            units, ids = pa.array([], pa.large_string()), Ids(np.zeros(0, "<u4"), np.zeros(0, np.int64))
        self.units, self.ids, self.again = units, ids, np.zeros(len(units), bool)

    def full(self, share: float = 1) -> bool:
        return len(self.units) > share * UNITS or self.units.nbytes + self.ids.data.nbytes > share * UNIT_BYTES

    def number(self, units: pa.Array) -> np.ndarray:
        """Each unit's place among the remembered ones; new ones are learnt."""
        numbered = units.dictionary_encode()
        units = numbered.dictionary
        at = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new):
            at[new] = len(self.units) + np.arange(len(new))
            units = units.take(pa.array(new))
            self.ids = self.ids + self.learn(units)
            self.units = pa.concat_arrays([self.units, units])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return at.take(numbered.indices.to_numpy())

    def learn(self, units: pa.Array) -> Ids:
        """The ids of new units, cut where the pattern does first, so that parts are encoded once."""
        bounds, parts = np.arange(len(units) + 1), units
        unlike = ~_holds(units, WORD)
        odd = np.flatnonzero(unlike)
        if len(odd):
            marked = units.take(pa.array(odd))
            for border in BORDERS:
                marked = pc.replace_substring_regex(marked, border, rf"\1{MARK}\2")
            cut = pc.split_pattern(marked, MARK)
            # the parts of the units in their order: one of each word, and those of the others
            n = np.ones(len(units), np.int64)
            n[odd] = np.diff(cut.offsets.to_numpy())
            bounds = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(np.arange(len(units)) - bounds[:-1], n) + np.arange(bounds[-1])
            of_odd = np.repeat(unlike, n)
            at[of_odd] = len(units) + np.arange(of_odd.sum())
            parts = pa.concat_arrays([units, cut.flatten()]).take(pa.array(at))
        numbered = parts.dictionary_encode()
        parts = numbered.dictionary
        word = _holds(parts, WORD)
        words, others = np.flatnonzero(word), np.flatnonzero(~word)
        ids = self.ask_words(parts.take(pa.array(words))) + self.ask_others(parts.take(pa.array(others)).to_pylist())
        place = np.empty(len(parts), np.int64)
        place[np.concatenate([words, others])] = np.arange(len(parts))
        codes = place.take(numbered.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(ids.sizes.take(codes))])
        return Ids(ids.of(codes).data, np.diff(ends[bounds]))

    def ask_words(self, words: pa.Array) -> Ids:
        """Have the library encode words of letters, many at a time, between line feeds."""
        lines = pa.ListArray.from_arrays(pa.array([*range(0, len(words), TOGETHER), len(words)], pa.int32()), words)
        found = self.words.encode_batch_fast(pc.binary_join(lines, pa.scalar("\n", words.type)).to_pylist(), add_special_tokens=False)
        feed = self.line_feed
        data = np.array([i for e in found for i in (*e.ids, *feed)], "<u4")
        ends = np.flatnonzero(data == feed[0])
        return Ids(data[data != feed[0]], np.diff(ends, prepend=-1) - 1)

    def ask_others(self, units: list[str]) -> Ids:
        """Have the library encode units one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return Ids(np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian u32 values."""
        if self.full():
            self.forget(np.flatnonzero(self.again))
            if self.full(0.5):
                self.forget(np.zeros(0, np.int64))
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")

        out, whole = [b""] * len(texts), _holds(texts, MARK)
        for token in self.added:
            whole |= _holds(texts, re.escape(token))
        # a text that holds an added token is encoded whole: its ids are not those of its units
        for k in np.flatnonzero(whole):
            out[k] = np.array(self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        runs = _holds(texts, f"[{SPACE}]{{2}}")
        unclear = runs & _holds(texts, f"[{SPACE}] [{SPACE}]")
        for marked, group in (" \n", ~runs), (" ", runs & ~unclear), ("", unclear):
            at = np.flatnonzero(group & ~whole)
            if not len(at):
                continue
            units = texts.take(pa.array(at))
            if marked:
                # every blank begins a unit; where no white space touches other, a line feed does as well
                for c in marked:
                    units = pc.replace_substring(units, c, MARK + c)
                units = pc.split_pattern(units, MARK)
            else:
                units = pa.array(map(self.split, units.to_pylist()), pa.list_(pa.large_string()))
            bounds, numbers = units.offsets.to_numpy(), self.number(units.flatten())
            ids = self.ids.of(numbers)
            edge = (4 * np.concatenate([[0], np.cumsum(ids.sizes)])[bounds]).tolist()
            data = ids.data.tobytes()
            for k, a, b in zip(at, edge, edge[1:]):
                out[k] = data[a:b]
        return out


# ----------------------------------------------------------------------- frames

def pack_frame(docs: list[tuple[int | None, bytes]], before: int, vocabulary: int) -> tuple[bytes, int]:
    """(frame, ids) of documents given as (doc_id, ids with the end id)."""
    total = sum(len(ids) for _, ids in docs) // 4
    head = FRAME.pack(b"IDS2", vocabulary, len(docs), total, before)
    head += np.array([d or 0 for d, _ in docs], "<i8").tobytes()
    head += bytes(d is not None for d, _ in docs)
    head += np.array([len(ids) // 4 for _, ids in docs], "<u4").tobytes()
    ids = np.frombuffer(b"".join(ids for _, ids in docs), "<u4")
    blocks = [encode_block(ids[k:k + BLOCK_IDS], vocabulary) for k in range(0, total, BLOCK_IDS)]
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks), total


def unpack_frame(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids of the partition before it, ids with the end id) of each document of a frame."""
    magic, vocabulary, n, total, before = FRAME.unpack_from(data)
    at = FRAME.size + 13 * n
    if magic != b"IDS2" or struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise ValueError("a frame's head is damaged")
    doc_ids = np.frombuffer(data, "<i8", n, FRAME.size).tolist()
    known = data[FRAME.size + 8 * n:FRAME.size + 9 * n]
    sizes = np.frombuffer(data, "<u4", n, FRAME.size + 9 * n).tolist()
    at, parts, read = at + 4, [], 0
    while read < total:
        ids, at = decode_block(data, at, vocabulary)
        parts.append(ids)
        read += len(ids)
    ids, k = np.concatenate(parts) if parts else np.zeros(0, "<u4"), 0
    for doc_id, has, size in zip(doc_ids, known, sizes):
        yield (doc_id if has else None), before + k, ids[k:k + size]
        k += size


# ------------------------------------------------------------------- on Spark

def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID) -> None:
    """Encode ``docs`` into frames at ``path``: rows (part, frame, n_ids, data), parts in doc_id order."""
    spark = docs.sparkSession
    ship(spark.sparkContext)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "k").sortWithinPartitions("doc_id", "k").select("doc_id", "text")
    # the vocabulary file goes to the workers by value: it need not lie on their disks
    sent = spark.sparkContext.broadcast(open(tokenizer, "rb").read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, frame, before, docs_, size = TaskContext.get().partitionId(), 0, 0, [], 0
        encoder = _encoder(sent)

        def flush():
            nonlocal frame, before, docs_, size
            data, n = pack_frame(docs_, before, encoder.vocabulary)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "frame": pa.array([frame], pa.int32()),
                                              "n_ids": pa.array([n], pa.int64()), "data": pa.array([data], pa.binary())})
            frame, before, docs_, size = frame + 1, before + n, [], 0
            return out

        for batch in batches:
            for piece in cut(batch, PIECE):
                encoded = encoder.encode(piece.column(1))
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoded):
                    docs_.append((doc_id, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= FRAME_IDS:
                        yield flush()
        if docs_:
            yield flush()

    rows.mapInArrow(run, "part int, frame int, n_ids bigint, data binary").write.parquet(path)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One encoder per worker process and vocabulary, kept from task to task."""
    import os
    import tempfile

    data = sent.value
    key = zlib.crc32(data)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with tempfile.NamedTemporaryFile(suffix=".json") as f:
            f.write(data)
            f.flush()
            _ENCODERS[key] = Encoder(f.name, added_as_text=False)
    return _ENCODERS[key]


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the frames at ``path``; with ``digest`` ids_crc32 instead of ids."""
    frames = spark.read.schema("part int, frame int, n_ids bigint, data binary").parquet(path)
    # one row per part: as many as write tasks
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    last = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def work(batch):
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs = list(unpack_frame(data.as_py()))
            out = {"part": [part] * len(docs), "doc_id": [d for d, _, _ in docs], "start": [s for _, s, _ in docs],
                   "n_tokens": [len(i) for _, _, i in docs]}
            if digest:
                yield out | {"ids_crc32": [zlib.crc32(i.tobytes()) for _, _, i in docs]}
            else:
                yield out | {"ids": [i.astype(np.int64) for _, _, i in docs]}

    docs = arrow_rows(frames.select("part", "data"), f"part int, doc_id bigint, start bigint, n_tokens bigint, {last}", work)
    return (docs.join(F.broadcast(starts), "part")
            .withColumn("start", F.col("start") + F.col("part_start")).drop("part", "part_start"))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token_blocks/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, digest=True)
