"""SentencePiece encoding and decoding over a relational lattice of pieces.

The text gets its leading blank, blanks become U+2581, and it is split into
units: blanks with the characters that follow them, a word's letters apart from a
stop after them. A character that stands in no longer piece (a line feed, say) is a
unit of its own. No piece reaches over the border of two units (``Model`` looks at
the whole vocabulary for that), so each unit is encoded alone, and a unit's ids
are the same wherever it occurs.

Dictionary (Spark): all words of letters in all texts are counted; the most frequent
ones - as many whole count levels as fit ``dictionary`` units - are encoded
relationally, with the blank before them. Their substrings up to the longest piece are exploded, joined to
the piece table (bounded by the vocabulary), grouped by unit, and folded with
the higher-order ``aggregate``:

* ``unigram`` models: Viterbi. The fold carries the best score and the last
  edge at every position, then walks the edges back.
* ``bpe`` models: the path of the highest summed score is not what such a model
  means (its scores are merge ranks), so the fold replays the merges on the
  same lattice: the state is the set of borders (one bit each), and each step
  applies the best edge that joins exactly two present segments.

The dictionary is bounded, so it is broadcast, and texts are encoded where they
are read, without a shuffle of texts. Units outside it, and those of more than
``LONGEST`` characters, are encoded in the task by the same rule (a short
Python helper with a bounded memory); no unit is cut or left out.

Defined cases
    * null text: null ids, and back to null. Empty text: no ids.
    * characters without a piece: one id per UTF-8 byte, or the unknown id
      (decoded as U+2047 between blanks) if the model has no byte pieces.
    * U+2581 in a text is the same as a blank to this encoding, so decoding
      returns a blank there.
    * very long units are encoded in O(n log n) (bpe) or O(n) (unigram).
    * repeated rows, null ids and extra columns: each row is encoded by itself
      and all columns are kept.
    * an empty table gives an empty dictionary and an empty result.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import materialize
from .common import arrow_rows, fresh

BLANK = "▁"
LONGEST = 62  # borders of a unit fit one bigint
DICTIONARY, MEMORY = 250_000, 200_000
LETTERS, STOPS = "A-Za-z\u00c0-\u024f", ",.;:!?"


class Model:
    """The piece table of a model file: text, score and id of each normal piece, and the byte ids."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_ids: list[int] | None = None,
                 kind: str = "bpe", first_id: int = 0, ids: list[int] | None = None, size: int | None = None):
        self.kind, self.unknown, self.byte_ids = kind, unknown, byte_ids
        self.ids = {p: i for (p, _), i in zip(pieces, ids or range(first_id, first_id + len(pieces)))}
        self.score = dict(pieces)
        self.costs = {p: -s for p, s in pieces}
        self.cost = self.costs.get
        self.longest = max((len(p) for p in self.ids), default=1)
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        # with a unit for every other character the pattern stays short: only blanks and inner characters join
        alone = "".join(sorted(c for c in "\n\t\r" if c not in inside))
        self.pattern = f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else "")
        letter = re.compile(f"[{LETTERS}]").match
        joined = {b for p in self.ids for a, b in zip(p, p[1:]) if letter(a)}
        if stops := "".join(c for c in STOPS if c not in joined):  # no piece has them after a letter
            self.pattern = f"{BLANK}*[{LETTERS}]+(?=[{stops}{BLANK}{alone}]|$)|{self.pattern}"
        assert not any(BLANK in p.lstrip(BLANK) for p in self.ids), "a piece reaches over a unit's border"
        self.bytes_of = [b""] * (size or max([*self.ids.values(), *(byte_ids or []), unknown], default=0) + 1)
        for p, i in self.ids.items():
            self.bytes_of[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(byte_ids or []):
            self.bytes_of[i] = bytes([b])
        if not byte_ids:
            self.bytes_of[unknown] = " ⁇ ".encode()

    @classmethod
    def load(cls, path: str) -> "Model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        normal = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in normal]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in every) else None
        # merge ranks are whole numbers, log probabilities are not
        kind = "bpe" if all(s == int(s) for _, s in pieces) else "unigram"
        return cls(pieces, sp.unk_id(), byte_ids, kind, ids=normal, size=len(every))

    # -------------------------------------------------- the rule, for one unit

    def encode_unit(self, unit: str) -> list[int]:
        parts = self.merged(unit) if self.kind == "bpe" else self.best_path(unit)
        out: list[int] = []
        for p in parts:
            out.extend(self.part_ids(p))
        return out

    def part_ids(self, part: str) -> list[int]:
        if part in self.ids:
            return [self.ids[part]]
        return [self.byte_ids[b] for b in part.encode()] if self.byte_ids else [self.unknown]

    def merged(self, unit: str) -> list[str]:
        parts, cost = list(unit), self.cost
        if len(parts) > 32:
            return self.merged_long(parts)
        none = float("inf")
        pairs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)  # the leftmost
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = cost(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = cost(parts[at - 1] + parts[at], none)
        return parts

    def merged_long(self, parts: list[str]) -> list[str]:
        """The same merges with a heap and a linked list."""
        score, n = self.score, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not parts[i] or after[i] >= n or parts[i] + parts[after[i]] != joined:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = joined, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def best_path(self, unit: str) -> list[str]:
        """The segmentation of the highest summed score; ties go to the longer last edge."""
        worst = self.unknown_score()
        best = [(0.0, 0)]
        for j in range(1, len(unit) + 1):
            here = (best[j - 1][0] + worst, j - 1)
            for i in range(max(0, j - self.longest), j):
                s = self.score.get(unit[i:j])
                if s is not None and (best[i][0] + s > here[0] or best[i][0] + s == here[0] and i < here[1]):
                    here = (best[i][0] + s, i)
            best.append(here)
        parts, j = [], len(unit)
        while j:
            parts.append(unit[best[j][1]:j])
            j = best[j][1]
        return parts[::-1]

    def unknown_score(self) -> float:
        return min(self.score.values(), default=0.0) - 10.0


# ----------------------------------------------------------- the lattice fold

def frequent_units(docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """(unit): the words of the highest count levels, at most ``most`` of them, each after a blank."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("word"))
    counts = materialize(words.where(F.length("word") < LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
                         .select(F.concat(F.lit(BLANK), "word").alias("unit"), F.floor(F.log2("n") * 4).alias("level"))).df
    # one row per quarter power of two: a few hundred at any size
    total, least = 0, None
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return counts.where(F.col("level") >= least if least is not None else F.lit(False)).select("unit")


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) by the relational lattice, for units of at most ``LONGEST`` characters."""
    spark = units.sparkSession
    table = spark.createDataFrame([(p, float(model.score[p]), i) for p, i in model.ids.items()], "piece string, score double, id int")
    starts = F.sequence(F.lit(0), F.length("unit") - 1)
    sub = units.select("unit", F.explode(starts).alias("i"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("unit") - F.col("i")))
    sub = sub.select("unit", "i", F.explode(lengths).alias("len"))
    sub = sub.select("unit", "i", "len", F.substring("unit", F.col("i") + 1, F.col("len")).alias("piece"))
    # the vocabulary bounds the piece table
    edges = sub.join(F.broadcast(table), "piece", "left").where("id is not null or len = 1")
    one = F.lit(1).cast("bigint")

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", one, c.cast("int"))

    end = F.col("i") + F.col("len")
    edge = F.struct(F.coalesce(-F.col("score"), F.lit(1e18)).alias("cost"), F.col("i"), end.alias("j"), F.col("id"),
                    bit(F.col("i")).bitwiseOR(bit(end)).alias("ends"),
                    (bit(end) - bit(F.col("i") + 1)).alias("inner"))
    grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    n = F.length("unit")
    fold = _merge_fold if model.kind == "bpe" else _viterbi_fold
    segments = fold(grouped.withColumn("n", n), model)

    def ids(s: Column) -> Column:
        part = F.substring(F.col("unit"), s["i"] + 1, s["j"] - s["i"])
        if not model.byte_ids:
            return F.array(F.coalesce(s["id"], F.lit(model.unknown)))
        code = F.encode(part, "UTF-8")
        table_ids = F.array(*[F.lit(b) for b in model.byte_ids])
        as_bytes = F.transform(F.sequence(F.lit(1), F.length(code)),
                               lambda k: F.get(table_ids, F.conv(F.hex(F.substring(code, k, F.lit(1))), 16, 10).cast("int")))
        return F.when(s["id"].isNotNull(), F.array(s["id"])).otherwise(as_bytes)

    return segments.select("unit", F.flatten(F.transform("segments", ids)).alias("ids"))


def _merge_fold(grouped: DataFrame, model: Model) -> DataFrame:
    """Borders as bits; each step drops the one border inside the best edge that has exactly one."""
    def joins_two(borders: Column):
        return lambda e: (borders.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(borders.bitwiseAND(e["inner"])) == 1)

    def step(borders: Column, _: Column) -> Column:
        best = F.get(F.filter("edges", joins_two(borders)), F.lit(0))
        return borders.bitwiseAND(F.bitwise_not(F.coalesce(best["inner"], F.lit(0).cast("bigint"))))

    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("n") + 1).cast("int")) - 1
    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    borders = grouped.withColumn("borders", F.aggregate(steps, full, step))

    def stands(e: Column) -> Column:
        return (F.col("borders").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("borders").bitwiseAND(e["inner"]) == 0)

    by_place = F.array_sort(F.filter("edges", stands), lambda a, b: a["i"] - b["i"])
    return borders.withColumn("segments", by_place)


def _viterbi_fold(grouped: DataFrame, model: Model) -> DataFrame:
    """Best score and last edge at every position, then the edges from the end back to the start."""
    unknown = -model.unknown_score()
    zero = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("int").alias("id"))

    def step(best: Column, j: Column) -> Column:
        into = F.filter("edges", lambda e: e["j"] == j)
        ways = F.transform(into, lambda e: F.struct(
            (F.get(best, e["i"])["cost"] + F.when(e["id"].isNull(), F.lit(unknown)).otherwise(e["cost"])).alias("cost"),
            e["i"].alias("i"), e["j"].alias("j"), e["id"].alias("id")))
        return F.concat(best, F.array(F.array_min(ways)))

    best = grouped.withColumn("best", F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(zero), step))

    def back(path: Column, _: Column) -> Column:
        at = F.when(F.size(path) == 0, F.col("n")).otherwise(F.get(path, F.lit(0))["i"])
        return F.when(at == 0, path).otherwise(F.concat(F.array(F.get("best", at)), path))

    nothing = F.filter(F.array(zero), lambda _: F.lit(False))
    return best.withColumn("segments", F.aggregate(F.sequence(F.lit(1), F.col("n")), nothing, back))


# ------------------------------------------------------------ texts, both ways

def encode(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids",
           dictionary: int = DICTIONARY) -> DataFrame:
    """``docs`` with the ids of ``text_col`` in ``ids_col`` (array of int)."""
    known = encode_units(frequent_units(docs, text_col, dictionary), model)
    # at most ``dictionary`` short rows, kept as Arrow bytes on the driver
    sink = pa.BufferOutputStream()
    table = known.select("unit", F.col("ids").cast("array<int>").alias("ids")).toArrow()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent = docs.sparkSession.sparkContext.broadcast((model, sink.getvalue().to_pybytes()))
    names = docs.columns
    at = [n.lower() for n in names].index(text_col.lower())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{ids_col}` array<int>"
    state: dict = {}

    def work(batch):
        if not state:
            state["units"] = re.compile(sent.value[0].pattern).findall
            state["memory"], state["frequent"] = {}, _dictionary(sent.value[1])
        rule, frequent, memory, units = sent.value[0], state["frequent"], state["memory"], state["units"]
        if len(memory) > MEMORY:
            memory.clear()
        out, offsets, absent = [], [0], []
        for text in batch.column(at).to_pylist():
            parts = []
            for u in units(BLANK + text.replace(" ", BLANK)) if text else ():
                ids = frequent.get(u) or memory.get(u)
                if ids is None:
                    ids = array("i", rule.encode_unit(u)).tobytes()
                    if len(u) <= LONGEST:
                        memory[u] = ids
                parts.append(ids)
            out.append(b"".join(parts))
            offsets.append(offsets[-1] + len(out[-1]) // 4)
            absent.append(text is None)
        values = pa.array(np.frombuffer(b"".join(out), np.int32))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(absent, pa.bool_()))
        return {**{n: batch.column(i) for i, n in enumerate(names)}, ids_col: lists}

    return arrow_rows(docs, schema, work)


def _dictionary(data: bytes) -> dict[str, bytes]:
    """unit -> its ids as little-endian 32-bit integers."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    if not table.num_rows:
        return {}
    ids = table.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    raw, ends = ids.values.to_numpy().astype("<i4").tobytes(), (4 * ids.offsets.to_numpy()).tolist()
    return {u: raw[a:b] for u, a, b in zip(table.column("unit").to_pylist(), ends, ends[1:])}


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids_col`` in ``out_col``: the pieces' bytes, joined, without the leading blank."""
    # one constant array for the whole vocabulary; a piece may be part of a character, so bytes are joined in hex
    pieces = F.split(F.lit(" ".join(b.hex() or "-" for b in model.bytes_of)), " ")
    joined = F.replace(F.array_join(F.transform(F.col(f"`{ids_col}`"), lambda i: F.get(pieces, i)), ""), F.lit("-"))
    text = F.make_valid_utf8(F.unhex(joined).cast("string"))
    return encoded.withColumn(out_col, F.substring(text, F.lit(2), F.length(text)))


def default_model() -> Model:
    import public_tokenizers

    return Model.load(public_tokenizers.path("piece_bpe_32k.model"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of ids, Spark's xxhash64 of the ids, whether they decode to the text."""
    docs, model = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_model()
    both = decode(encode(docs, model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.xxhash64("ids").alias("ids_xxhash64"),
                       F.col("decoded").eqNullSafe(F.replace("text", F.lit(BLANK), F.lit(" "))).alias("round_trip"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids; the last stage."""
    return encode(docs, default_model(), ids_col=fresh("ids", docs.columns))
