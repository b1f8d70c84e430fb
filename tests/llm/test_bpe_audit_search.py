"""Heap BPE, the filter audit and ranked search against the library and plain brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cohortgraph.llm import bpe, filter_audit, lexical
from tests.conftest import SF001

ODD_TEXTS = [
    "", " \n\t", "a<|endoftext|>b <|startoftext|>", "ΑΣ Σ İstanbul Å é ﬁ", "日本語 テキスト 12345", "don't we'll I'M 'S 're're",
    "x\x1cy a\x85b c d", "x" * 5000, "ab" * 3000 + "!" * 200, "🙂👍🏽 ‍", "́a ͅ", "<|endof text|>", "a b \x00 d \x7f",
    "Привет мир", "école É", "1,234.5%", "^^ >> << `` __",
]


# ------------------------------------------------------------------ op11

@pytest.fixture(scope="module")
def word_bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def plain_merge(model, ids):
    """The least rank first, leftmost of equals, one merge at a time."""
    while True:
        found = [(model.merges[p], k) for k, p in enumerate(a << bpe.BITS | b for a, b in zip(ids, ids[1:])) if p in model.merges]
        if not found:
            return ids
        packed, k = min(found)
        ids = [*ids[:k], packed & (1 << bpe.BITS) - 1, *ids[k + 2:]]


def test_heap_merges_like_repeated_search(word_bpe):
    model, rng = bpe.Bpe(open(word_bpe[0]).read()), random.Random(4)
    for _ in range(400):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 40)))
        assert model.merge(model.symbols(word)) == plain_merge(model, model.symbols(word))


def test_small_memory_changes_no_id(word_bpe, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    model = bpe.Bpe(open(word_bpe[0]).read())
    for text in [*ODD_TEXTS, "one two three four five six one two seven eight one"] * 2:
        assert model.encode(text) == word_bpe[1].encode(text, add_special_tokens=False).ids


def test_registered_bpe_query(spark, documents, word_bpe):
    want = {}
    for doc_id, text in documents:
        ids = word_bpe[1].encode(text or "", add_special_tokens=False).ids
        decoded = word_bpe[1].decode(ids, skip_special_tokens=False)
        want[doc_id] = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op11_bpe(spark, SF001).collect()}
    assert got == want


def test_bpe_odd_rows(spark, odd, none, word_bpe):
    rows = bpe.encode(odd.withColumn("n_tokens", F.lit("own")), word_bpe[0]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = word_bpe[1].encode(r["text"] or "", add_special_tokens=False).ids
        # the table has columns ids and n_tokens of its own
        assert (r["n_tokens"], r["n_tokens_"], r["ids"], r["ids_"]) == ("own", len(ids), [1], ids)
        assert r["decoded"] == word_bpe[1].decode(ids, skip_special_tokens=False)
    texts = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string")
    for r in bpe.encode(texts, word_bpe[0]).collect():
        ids = word_bpe[1].encode(r["text"], add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, word_bpe[1].decode(ids, skip_special_tokens=False))
    assert bpe.encode(none, word_bpe[0]).count() == 0


# ------------------------------------------------------------------ op12

def brute_audit(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for d, t, p in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": d is not None and d > least[t]}
        parts[p or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone)]
                left = kept
        for f in "ABCDE":
            mine = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in mine)
            for k in mine:
                out[k].append(total)
    return out


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_plain_changes_meet_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in filter_audit.adjacent_orders(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_swaps_share_equal_nodes():
    counts = {m: (1, 0, 0) for m in range(32)}
    diagram = filter_audit.Diagram("ABCDE", counts)
    for level in filter_audit.adjacent_orders(5):
        diagram.swap(level)
        assert [len(nodes) for nodes in diagram.levels] == [1] * 5


def test_audit_against_brute_force(spark, odd, none):
    long = " ".join(f"w{i}" for i in range(120))
    own = [(100, long, "de"), (101, long, "de"), (101, long, "de"), (99, long, None), (102, "A" + long, ""), (103, long + " $", "de"),
           (104, "w " * 150, "de"), (105, "ABC DEF", "fr"), (None, long, "fr"), (106, None, None), (107, "", "xx")]
    docs = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()] + own
    labels = [(100, 1, 0), (101, 1, 1), (101, 0, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (99, None, None), (107, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("n", F.lit("x")).withColumn("part", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x"))
    assert as_dict(filter_audit.audit(filter_audit.class_counts(frame, marks))) == brute_audit(docs, labels)
    assert filter_audit.audit(filter_audit.class_counts(none, marks)).count() == 0
    assert as_dict(filter_audit.audit(filter_audit.class_counts(frame, marks.limit(0)))) == brute_audit(docs, [])


# ------------------------------------------------------------------ op13

def brute_search(docs, items, k=10):
    def bag(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low))

    bags = [(d, b, sum(b.values())) for d, b in ((d, bag(t)) for d, t in docs) if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    one = {}
    for i, t in items:
        if i is not None:
            one[i] = t if i not in one else min([one[i], t], key=lambda x: (x is not None, x or ""))
    out = []
    for i, text in one.items():
        found = []
        for d, b, n in bags:
            m = 25 + (75 * n * n_docs) // length
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
                        for t, c in bag(text).items() if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


@pytest.mark.parametrize("case", ["plain", "blocks", "collisions"])
def test_search_against_brute_force(spark, case):
    rng = random.Random(8)
    words = ["Rot", "rot", "blau", "grün", "GRÜN", "Żó", "x1", "the", "a-b", "日本"]
    docs = [(d if d % 9 else None, " ".join(rng.choices(words, weights=range(1, 11), k=rng.randint(0, 12)))) for d in range(120)]
    docs += [(500 + d, "the rot the") for d in range(40)] + [(7, "the rot the"), (7, "the rot the"), (600, None), (601, ""), (602, ".,;")]
    items = [(1, "the rot"), (2, "the the the blau"), (3, "unknown"), (4, None), (5, "日本 grün x1"), (None, "rot"), (6, "Żó"), (6, "rot"), (9, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7).withColumn("rank", F.lit("x")).withColumn("bag", F.lit(1))
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    more = {"plain": {}, "blocks": {"block_bytes": 1},
            "collisions": {"hashes": lambda bag, attempt: lexical.bag_hashes(bag if attempt else F.substring(bag, 1, 1), attempt)}}[case]
    assert rows_of(lexical.search(frame, asked, **more)) == brute_search(docs, items)


def test_search_odd_and_empty_tables(spark, odd, none):
    asked = spark.createDataFrame([(1, "one two x"), (2, "w5 w6 shared7")], "item_id bigint, text string")
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(lexical.search(odd, asked)) == brute_search(docs, [(1, "one two x"), (2, "w5 w6 shared7")])
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(odd, asked.limit(0)).count() == 0


def test_postings_in_slices(monkeypatch):
    items = lexical.Items([(k, "a b c " * (k + 1)) for k in range(5)])
    entries = ([0, 0, 1, 2], [0, 1, 2, 0], [5, 7, 11, 13])
    import numpy as np

    whole = items.scores(*map(np.array, entries), 3)
    monkeypatch.setattr(lexical, "CELLS", 1)
    assert (items.scores(*map(np.array, entries), 3) == whole).all()
    assert whole.tolist() == [[12 * (k + 1) for k in range(5)], [11 * (k + 1) for k in range(5)], [13 * (k + 1) for k in range(5)]]
