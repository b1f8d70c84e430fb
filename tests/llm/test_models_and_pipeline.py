"""Toxicity by held-out accuracy, SentencePiece against its library, and the pipeline's stages."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from cohortgraph.llm import decontaminate, lattice, line_dedup, minhash, toxicity
from tests.conftest import SF001


# --------------------------------------------------------------------- toxicity

def insults(n, rng):
    words = ["".join(rng.choice(["er", "an", "th", "in", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        bad = k % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["scumbag", "idiotic", "moronish", "trashy"])
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_network_learns_and_reads_every_window():
    texts, labels = insults(500, random.Random(10))
    net = toxicity.train(texts[:360], labels[:360])
    scorer = toxicity.Scorer(net)
    right = (scorer.scores(texts[360:]) >= toxicity.THRESHOLD) == (np.array(labels[360:]) == 1)
    assert right.mean() > 0.9
    clean = " ".join("ther anin" for _ in range(3000))
    late = clean + " scumbag idiotic trashy scumbag ther"
    low, high = scorer.scores([clean, late])
    assert low < 0.5 < high


def test_gradient_is_the_slope():
    texts = ["ab cd ef gh ij", "kl mn ab op", "qr st"]
    net = toxicity.Network(hidden=3, word_dim=2, char_dim=3, attention=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = toxicity.Vocabulary()
    ids, _ = toxicity.windows_of([np.array(words.ids(t)) for t in texts])
    feats, y = toxicity.features(words.new_words()), np.array([1.0, 0.0, 1.0])

    def loss():
        vectors = net.embed(feats)
        return net.gradient(feats, vectors, net.project(vectors), ids, y)

    g, _ = loss()
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept, step = net.p[name][at], 1e-3
        net.p[name][at] = kept + step
        up = loss()[1]
        net.p[name][at] = kept - step
        down = loss()[1]
        net.p[name][at] = kept
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4), name


def test_held_out_rows_and_odd_cases(spark, odd, none):
    labels = spark.createDataFrame([(d, 1, int(d in (8, 9))) for d in range(1, 18)] + [(None, 1, 1), (4, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    net = toxicity.fit(odd, labels, epochs=1, least_steps=1)
    got = toxicity.score(odd.drop("score"), net).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    bare = [r["score"] for r in got if not (r["text"] or "").strip()]
    assert len(set(bare)) == 1  # null and empty texts score as the empty window
    flags = {r["doc_id"]: r["h"] for r in odd.select("doc_id", (toxicity.remainder() == 1).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in flags.items() if d is not None)
    assert toxicity.fit(odd, labels.limit(0)).constant == 0.0
    assert toxicity.score(none.drop("score"), net).count() == 0


# ---------------------------------------------------------------- SentencePiece

def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("dictionary", [0, 50, lattice.DICTIONARY])
def test_ids_are_the_librarys_and_decode_back(spark, odd, documents, dictionary):
    model, sp = lattice.default_model(), library()
    docs = odd.drop("ids").select("doc_id", "text", "x", "pos").union(
        spark.createDataFrame([(d, t, "x", "p") for d, t in documents[:60]], "doc_id bigint, text string, x string, pos string"))
    both = lattice.decode(lattice.encode(docs, model, dictionary=dictionary), model).collect()
    for r in both:
        assert (None if r["text"] is None else sp.encode(r["text"])) == r["ids"], (r["text"] or "")[:60]
        assert r["decoded"] == (r["text"] and r["text"].replace("▁", " "))


def test_relational_lattice_is_the_rule(spark, documents):
    model = lattice.default_model()
    units = lattice.frequent_units(spark.createDataFrame(documents, "doc_id bigint, text string"), "text", 10 ** 9)
    for u, ids in lattice.encode_units(units, model).collect():
        assert list(ids) == model.encode_unit(u), u


def best_by_trying(model, unit):
    """The highest score over all segmentations."""
    if not unit:
        return 0.0
    ways = [model.score[unit[:n]] + best_by_trying(model, unit[n:]) for n in range(1, len(unit) + 1) if unit[:n] in model.score]
    return max(ways + [model.unknown_score() + best_by_trying(model, unit[1:])])


def test_viterbi_fold_of_a_unigram_model(spark):
    rng = random.Random(11)
    pieces = sorted({"▁" * rng.randint(0, 1) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(25)})
    model = lattice.Model([(p, -rng.random() * 9) for p in pieces], unknown=0, kind="unigram", first_id=1)
    text_of = {i: p for p, i in model.ids.items()}
    units = ["▁" + "".join(rng.choice("abcx") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    rows = lattice.encode_units(spark.createDataFrame([(u,) for u in set(units)], "unit string"), model).collect()
    assert len(rows) == len(set(units))
    for u, ids in rows:
        total = sum(model.score[text_of[i]] if i else model.unknown_score() for i in ids)
        assert total == pytest.approx(best_by_trying(model, u)), u


def test_no_texts_to_encode(none):
    model = lattice.default_model()
    assert lattice.decode(lattice.encode(none.drop("ids"), model), model).count() == 0


# --------------------------------------------------------------------- pipeline

def test_stages_in_order_and_their_columns(spark):
    assert [f for _, f in corpus_pipeline.STAGES] == [
        toxicity.stage, line_dedup.stage, minhash.stage, decontaminate.stage, lattice.stage]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = corpus_pipeline.run(spark, SF001)
    assert out.columns == [*docs.columns, "ids"]
    rows, bench = out.collect(), spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    sp = library()
    assert 0.5 * docs.count() < len(rows) < docs.count()
    assert all(r["ids"] == sp.encode(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
    # brute force over what is left: no exact benchmark item, no repeated window of lines, no near copies
    normal = [decontaminate.normal(r["text"]) for r in rows]
    assert not any(decontaminate.normal(b["text"]) in t for b in bench for t in normal)
    seen = [w for r in rows for w in {tuple(r["text"].split("\n")[i:i + 3]) for i in range(r["text"].count("\n") - 1)} if any(w)]
    assert len(seen) == len(set(seen))
    sets = [s for s in minhash.shingles([r["text"] for r in rows]) if len(s[0])]
    assert not any(minhash.probability_jaccard(a, b) >= 0.8 for k, a in enumerate(sets) for b in sets[:k])
