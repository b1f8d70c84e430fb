"""Substring dedup, sharding and token blocks against brute force and round trips."""

from __future__ import annotations

import bisect
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from cohortgraph.llm import rangecoder as R
from cohortgraph.llm import sharding as H
from cohortgraph.llm import substring_dedup as S
from cohortgraph.llm import token_blocks as B


# -------------------------------------------------------------- substring dedup

def brute_spans(rows, window=13):
    first = {}
    words = [(d, S.WORD.findall(t or "")) for d, t in rows]
    for d, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    out = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - window + 1) for k in range(window)
                if d is not None and first[tuple(w[i:i + window])] < d}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


def got_spans(df):
    rows = S.dedup_substrings(df).collect()
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in rows)
    return sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in rows)


def test_spans_of_texts_made_of_few_words(spark, monkeypatch):
    """Many overlapping repeats, in shards and tasks of a few words."""
    monkeypatch.setattr(S, "SHARD_WORDS", 300)
    monkeypatch.setattr(S, "TASK_WORDS", 500)
    rng, rows, pool = random.Random(6), [], []
    for d in rng.sample(range(1000), 120):
        w = []
        while len(w) < rng.randint(1, 200):
            if pool and rng.random() < 0.5:
                src = rng.choice(pool)
                a = rng.randrange(max(1, len(src) - 10))
                w += src[a:a + rng.randint(5, 60)]
            else:
                w += [rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randint(1, 20))]
        pool.append(w)
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(w)))
    assert got_spans(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_spans(rows)


def test_span_odd_cases(odd, none):
    assert got_spans(odd) == brute_spans([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert S.dedup_substrings(none).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(7)
    for _ in range(60):
        docs = [(d, [rng.choice("abc") for _ in range(rng.randint(1, 40))]) for d in range(6)]
        automaton = S.Automaton(4)
        for d, w in docs:
            automaton.add(w, d)
        automaton.finish()
        first = {}
        for d, w in docs:
            for i in range(len(w) - 3):
                first.setdefault(tuple(w[i:i + 4]), d)
        asked, who = [rng.choice("abcd") for _ in range(60)], rng.randint(0, 6)
        gone = {i + k for i in range(57) for k in range(4) if first.get(tuple(asked[i:i + 4]), 99) < who}
        assert {i for a, b in automaton.spans(asked, who) for i in range(a, b)} == gone


# --------------------------------------------------------------------- sharding

def plain_best_fit(sizes, capacity):
    left, out, bins = [], [], 0
    for s in sizes:
        i = bisect.bisect_left(left, (s, -1))
        if i < len(left):
            room, b = left.pop(i)
        else:
            room, b, bins = max(capacity, s), bins, bins + 1
        out.append(b)
        if room > s:
            bisect.insort(left, (room - s, b))
    return out


def test_tree_packs_as_a_sorted_list_does():
    rng = random.Random(8)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 200))), reverse=True)
        capacity = rng.randint(20, 300)
        assert H.best_fit(sizes, capacity) == plain_best_fit(sizes, capacity)


def test_pack_uses_no_more_shards_and_is_near_even():
    sizes = sorted((int(random.Random(9).lognormvariate(8, 1)) + k for k in range(5000)), reverse=True)
    load = defaultdict(int)
    for s, b in zip(sizes, H.pack(sizes, 24)):
        load[b] += s
    assert len(load) == 24 and min(load.values()) > 0.99 * max(load.values())
    assert H.pack([], 24) == [] and H.pack([5], 24) == [0]


@pytest.mark.parametrize("hot", [0.03, 0.05, 0.1, 1 / 3, 0.95])
def test_pack_shares_the_rest_evenly_beside_large_groups(hot):
    rest = sorted((int(random.Random(k).lognormvariate(8, 0.5)) + 1 for k in range(5000)), reverse=True)
    large = int(sum(rest) * hot / (1 - hot))
    sizes = sorted([large, large // 2, *rest], reverse=True)
    load, of = [0] * 24, H.pack(sizes, 24)
    for s, b in zip(sizes, of):
        load[b] += s
    own = H.lone(sizes, 24, sum(sizes))
    assert [load[of[k]] for k in range(own)] == sizes[:own]
    others = sorted(load, reverse=True)[own:]
    assert min(others) > 0.99 * max(others)


def test_shards_beside_a_group_of_a_third_of_all_bytes(spark):
    rows = [(d, "copy " * 40) for d in range(6000)] + [(6000 + d, f"{d:06} " + "own " * 48) for d in range(12_000)]
    got = H.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check_shards(rows, got)
    load = defaultdict(int)
    for r in got:
        load[r["shard"]] += r["size"]
    hot, *others = sorted(load.values(), reverse=True)
    assert hot == 6000 * 208 and len(others) == 23 and min(others) > 0.98 * max(others)


def check_shards(rows, got):
    want = sorted(repr((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for d, t in rows)
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == want
    slots, shard_of = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        key = (r["k1"], r["k2"])
        assert shard_of.setdefault(key, r["shard"]) == r["shard"]  # a group is not divided
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert len(shard_of) == len({t for _, t in rows})


def test_shards_of_the_documents(spark, documents):
    got = H.shard(spark.createDataFrame(documents, "doc_id bigint, text string")).collect()
    check_shards(documents, got)


def test_shard_odd_cases(odd, none):
    check_shards([tuple(r) for r in odd.select("doc_id", "text").collect()], H.shard(odd).collect())
    assert H.shard(none).count() == 0


# ------------------------------------------------------------------ token blocks

@pytest.mark.parametrize("n", [1, 2, 31, 63, 64, 65, 1000, 70_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.integers(0, 3, n), np.full(n, 50256), np.arange(n) % 300):
        data = R.encode_block(ids, 50257)
        back, end = R.decode_block(b"xx" + data + b"yy", 2, 50257)
        assert (back == ids).all() and end == len(data) + 2
    assert len(R.encode_block(np.arange(n) % 7, 50257)) < 6 * n + 64


def test_damage_is_found():
    data = bytearray(R.encode_block(np.arange(5000) % 977, 50257))
    data[700] ^= 4
    with pytest.raises(ValueError):
        R.decode_block(bytes(data), 0, 50257)
    frame = bytearray(B.pack_frame([(1, np.arange(9, dtype="<u4").tobytes()), (None, b"\2\0\0\0")], 5, 50257)[0])
    assert [(d, s, i.tolist()) for d, s, i in B.unpack_frame(bytes(frame))] == [(1, 5, list(range(9))), (None, 14, [2])]
    frame[30] ^= 1
    with pytest.raises(ValueError):
        list(B.unpack_frame(bytes(frame)))


TEXTS = ["", "  ", "a  b", "a   b", " \n x", "x \n y", "x\n y", "x \n", "\n\n a", "a\n \nb", "\t\tq  \t z", "é́ ñ̃ x",
         "don't we'll 'S ''s x's 12½ ²a _a_ a_b", "日本 語　x", "a\xa0 b\xa0 \xa0c", "\x1c a\x1c b", "<|endoftext|> x"]


def test_added_tokens_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = B.Encoder(path, added_as_text=False), Tokenizer.from_file(path)
    texts = ["plain text", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y  z", "plain <|endoftex|> text",
             "\u00a0 <|endoftext|> \u65e5\u672c", None, "", "a b"]
    for _ in range(2):  # also with the memory filled
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[2] == [50256]


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_units_encode_as_whole_texts_do(documents):
    encoder, whole = B.Encoder(public_tokenizers.path("byte_bpe_50k.json")), tokenizer()
    texts = TEXTS + [t for _, t in documents]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:50]


def odd_texts(n, seed=12):
    rng = random.Random(seed)
    bits = [" ", " ", " ", "\n", "\n", "\t", "\r\n", "\xa0", "\u3000", "\u180e", "\x1c", "\x01", "'", "'s", "'ve", ".", ",", "!?", "(", "##", "-",
            "_", "7", "2024", "\u00b2", "\u00bd", "\u0660", "the", "Word", "x", "S", "\u00e9", "\u00d7", "e\u0301", "\u0416\u0434", "\u65e5\u672c", "\ufb01",
            "\u03b1\u03b2", "\U0001f600", "\U00031350", "\ua7dc", "\u0d3d", "\u200b", "\ufeff", "<|endoftext|>", "<|endof", "\x00", "\x85"]
    return ["".join(rng.choices(bits[:rng.choice([3, 5, 30, len(bits)])] + ["ab", "Cd"], k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("units", [B.UNITS, 40])
def test_odd_texts_have_the_ids_of_the_library(monkeypatch, units):
    """Also with a memory that is full after every call."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(B, "UNITS", units)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = B.Encoder(path, added_as_text=False), Tokenizer.from_file(path)
    texts = odd_texts(6000)
    for k in range(0, len(texts), 150):
        for t, ids in zip(texts[k:k + 150], encoder.encode(texts[k:k + 150])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_library_encodes_a_word_once_whatever_follows_it():
    from tokenizers import Tokenizer

    asked = []

    class Counting:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **kw):
            asked.extend(w for t in texts for w in t.split())
            return self.library.encode_batch_fast(texts, **kw)

    encoder = B.Encoder(public_tokenizers.path("byte_bpe_50k.json"), added_as_text=False)
    for name, value in list(vars(encoder).items()):
        if isinstance(value, Tokenizer):
            setattr(encoder, name, Counting(value))
    words = ["w" + "abcdefghij"[k // 10] + "abcdefghij"[k % 10] for k in range(100)]
    text = " ".join(w + end for w in words for end in ("", ",", ".", "!", "?\nEnd", ".\nEnd"))
    for _ in range(2):
        encoder.encode([text, text])
    assert 100 < len(asked) < 120


def test_units_met_again_stay_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(B, "UNITS", 100)
    encoder = B.Encoder(public_tokenizers.path("byte_bpe_50k.json"), added_as_text=False)
    for k in range(40):
        encoder.encode(["of old " + " ".join(f"new{k}x{i}" for i in range(20))])
        assert len(encoder.units) <= 130
    assert {"of", " old"} <= set(encoder.units.to_pylist())


@pytest.mark.parametrize("frame_ids", [B.FRAME_IDS, 100])
def test_written_ids_are_read_back(spark, odd, tmp_path, monkeypatch, frame_ids):
    monkeypatch.setattr(B, "FRAME_IDS", frame_ids)
    path, whole = str(tmp_path / "ids"), tokenizer()
    B.write_tokens(odd, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in B.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids").collect()), key=lambda r: r[1])
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    want = sorted(repr((d, whole.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    assert sorted(repr((d, list(ids))) for d, _, _, ids in got) == want
    crc = {r["start"]: r["ids_crc32"] for r in B.read_tokens(spark, path, digest=True).collect()}
    assert crc == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, _, ids in got}


def test_written_added_token_has_its_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id bigint, text string")
    B.write_tokens(docs, str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: list(r["ids"]) for r in B.read_tokens(spark, str(tmp_path / "ids")).collect()}
    assert 50256 in got[1] and 50256 not in got[2]


def test_empty_table_of_tokens(spark, none, tmp_path):
    B.write_tokens(none, str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    assert B.read_tokens(spark, str(tmp_path / "ids")).count() == 0
