"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Every word enters as a word vector (hashed vocabulary) beside a character
vector (the sum of hashed, boundary-marked character n-grams). A forward and a
backward GRU read a window of words; attention weighs their states into one
vector and a linear layer gives the window's logit. A document scores as its
worst window, over all overlapping windows of its whole text.

Training is numpy on the driver, over a bounded sample of labelled rows:
``max_pos`` toxic and ``max_neg`` other documents, those with the least hash
of doc_id, never from the held-out third (crc32 of the doc_id as text, modulo
3, is 1). Each epoch takes at most ``train_windows`` random windows of a
document, and learns from the worst one. The sample is the only thing that
reaches the driver. Scoring covers every row: the network (a few MB) is
broadcast and documents are scored where they are read, without a shuffle.

Defined cases
    * null and empty texts, and texts without word characters: one empty
      window, whose score is the network's bias.
    * a run of more than ``LONGEST`` word characters is read as several words.
    * repeated rows score alike; null doc_id counts as not held out.
    * no usable labels, or labels of one class only: an untrained network
      whose scores all equal the share of label 1 (0 without labels).
    * null labels are not used; several labels for a doc_id: any 1 counts.
    * extra columns are not looked at (``score``) or kept (``stage``).
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import materialize
from .common import arrow_rows, fresh, hash_words, mix64

LONGEST = 40
WORDS = re.compile(rf"\w{{1,{LONGEST}}}")
WINDOW, STRIDE = 48, 32
BUCKETS = 1 << 15
GRAMS = (3, 5)
THRESHOLD = 0.7


# ------------------------------------------------------------------ the words

def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, n-gram buckets one after another, first n-gram of each word)."""
    marked = np.array([f"^{w}$" for w in words], dtype=f"U{LONGEST + 2}")
    width = marked.dtype.itemsize // 4
    codes = marked.view(np.uint32).reshape(len(words), width).astype(np.uint64)
    lengths = np.count_nonzero(codes, axis=1)
    codes = codes[:, :lengths.max()]
    rows, grams = [], []
    for n in GRAMS:
        if codes.shape[1] < n:
            break
        h = np.full((len(words), codes.shape[1] - n + 1), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + codes[:, i:codes.shape[1] - n + 1 + i]
        at, pos = np.nonzero(np.arange(h.shape[1]) <= lengths[:, None] - n)
        rows.append(at)
        grams.append(mix64(h[at, pos]) % np.uint64(BUCKETS))
    row, gram = np.concatenate(rows), np.concatenate(grams).astype(np.int64)
    order = np.argsort(row, kind="stable")
    starts = np.searchsorted(row[order], np.arange(len(words)))
    return (hash_words(words) % np.uint64(BUCKETS)).astype(np.int64), gram[order], starts


def joined(parts):
    """One set of features from those of consecutive lists of words."""
    shift = np.cumsum([0, *(len(gram) for _, gram, _ in parts)])
    return (np.concatenate([word for word, _, _ in parts]), np.concatenate([gram for _, gram, _ in parts]),
            np.concatenate([starts + k for (_, _, starts), k in zip(parts, shift)]))


def some(feats, words: np.ndarray):
    """The features of the words with these numbers only."""
    word, gram, starts = feats
    sizes = np.diff(np.append(starts, len(gram)))[words]
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts[words] - first, sizes)
    return word[words], gram[at], first


class Vocabulary:
    """Word numbers, and the features of the words met so far; starts anew beyond ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.clear()

    def clear(self):
        n = count()
        self.number: dict[str, int] = _Numbering(n.__next__)
        self.done = 0

    def ids(self, text: str | None) -> list[int]:
        number = self.number
        return [number[w] for w in WORDS.findall(text.lower())] if text else []

    def new_words(self) -> list[str]:
        words = list(self.number)[self.done:]
        self.done += len(words)
        return words


class _Numbering(dict):
    def __init__(self, give):
        super().__init__()
        self.give = give

    def __missing__(self, key):
        self[key] = n = self.give()
        return n


def windows_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word ids by window, -1 beyond the end; the document of each window)."""
    blocks, owner = [], []
    for k, ids in enumerate(docs):
        n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
        padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int64)
        padded[:len(ids)] = ids
        blocks.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
        owner.append(np.full(n, k))
    return np.concatenate(blocks), np.concatenate(owner)


# ---------------------------------------------------------------- the network

def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters, the forward pass, and the gradient of one batch of windows."""

    def __init__(self, hidden: int = 10, word_dim: int = 8, char_dim: int = 12, attention: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)

        def matrix(*shape, scale=None):
            return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        self.hidden, self.constant = hidden, None
        self.p = {"word": matrix(BUCKETS, word_dim, scale=0.1), "char": matrix(BUCKETS, char_dim, scale=0.1),
                  "att": matrix(2 * hidden, attention), "att_b": np.zeros(attention, np.float32),
                  "att_v": matrix(attention), "out": matrix(2 * hidden), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": matrix(word_dim + char_dim, 3 * hidden), f"in_b_{d}": np.zeros(3 * hidden, np.float32),
                       f"rec_{d}": matrix(hidden, 3 * hidden)}

    def embed(self, feats) -> np.ndarray:
        """The input vector of each word, from ``features``."""
        word, gram, starts = feats
        share = np.diff(np.append(starts, len(gram))).astype(np.float32) ** -0.5
        chars = np.add.reduceat(self.p["char"][gram], starts, axis=0) * share[:, None]
        return np.concatenate([self.p["word"][word], chars], axis=1)

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates, by direction; the last row belongs to no word."""
        v = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        return {d: v @ self.p[f"in_{d}"] + self.p[f"in_b_{d}"] for d in "fb"}

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window of ``ids``; ``keep`` gets what the gradient needs."""
        (n, steps), H = ids.shape, self.hidden
        valid = ids >= 0
        full = bool(valid.all())
        states = np.zeros((steps, n, 2 * H), np.float32)
        for d, at in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            h, rec = np.zeros((n, H), np.float32), self.p[f"rec_{d}"]
            for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
                x, u = gates[d][ids[:, t]], h @ rec
                zr = sigmoid(x[:, :2 * H] + u[:, :2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(x[:, 2 * H:] + r * u[:, 2 * H:])
                new = c + z * (h - c)
                if not full:
                    new = np.where(valid[:, t, None], new, h)
                if keep is not None:
                    keep[d, t] = (h, z, r, c, u[:, 2 * H:])
                h = new
                states[t, :, at] = h
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"]
        e[~valid.T] = -1e9
        w = np.exp(e - e.max(axis=0))
        w *= valid.T
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, states)
        if keep is not None:
            keep |= {"states": states, "a": a, "w": w, "pooled": pooled, "valid": valid}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradient(self, feats, vectors, gates, ids, labels) -> tuple[dict, float]:
        """Of the mean cross-entropy of the windows ``ids``; (by parameter, the loss)."""
        k: dict = {}
        logit = self.forward(gates, ids, k)
        prob = sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(labels > 0, prob, 1 - prob) + 1e-7)))
        H, p = self.hidden, self.p
        g = {name: np.zeros_like(v) for name, v in p.items()}
        d_logit = ((prob - labels) / len(labels)).astype(np.float32)
        g["out"], g["out_b"] = k["pooled"].T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["out"]
        w, states, a = k["w"], k["states"], k["a"]
        d_w = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        d_a = d_e[..., None] * p["att_v"] * (1 - a * a)
        g["att_v"] = np.einsum("tn,tnk->k", d_e, a)
        g["att"], g["att_b"] = np.einsum("tnh,tnk->hk", states, d_a), d_a.sum(axis=(0, 1))
        d_states = w[..., None] * d_pooled + d_a @ p["att"].T
        d_vectors = np.zeros((len(vectors) + 1, vectors.shape[1]), np.float32)
        padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        steps = ids.shape[1]
        for d, at in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            d_gate = np.zeros_like(gates[d])
            dh = np.zeros((len(ids), H), np.float32)
            for t in (range(steps - 1, -1, -1) if d == "f" else range(steps)):
                h, z, r, c, uc = k[d, t]
                dh = dh + d_states[t, :, at]
                on = k["valid"][:, t, None]
                new = np.where(on, dh, 0)
                dc = new * (1 - z) * (1 - c * c)
                dz = new * (h - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"rec_{d}"] += h.T @ du
                np.add.at(d_gate, ids[:, t], np.concatenate([dz, dr, dc], axis=1))
                dh = np.where(on, new * z + du @ p[f"rec_{d}"].T, dh)
            g[f"in_{d}"], g[f"in_b_{d}"] = padded.T @ d_gate, d_gate.sum(axis=0)
            d_vectors += d_gate @ p[f"in_{d}"].T
        word, gram, starts = feats
        dims = p["word"].shape[1]
        np.add.at(g["word"], word, d_vectors[:-1, :dims])
        counts = np.diff(np.append(starts, len(gram)))
        np.add.at(g["char"], gram, np.repeat(d_vectors[:-1, dims:] * counts[:, None].astype(np.float32) ** -0.5, counts, axis=0))
        return g, loss


def train(texts: list[str], labels: list[int], epochs: int = 6, least_steps: int = 300, batch: int = 48, rate: float = 0.01,
          train_windows: int = 16, seed: int = 11, **sizes) -> Network:
    """A network that has learnt from each document's worst window (Adam, cross-entropy).

    There are ``epochs`` epochs, or as many as ``least_steps`` steps need.
    """
    net, y = Network(**sizes), np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    words = Vocabulary(limit=1 << 62)
    docs = [np.array(words.ids(t), np.int64) for t in texts]
    listed = words.new_words()
    if not listed:
        net.constant = float(y.mean())
        return net
    known = joined([features(listed[k:k + 20_000]) for k in range(0, len(listed), 20_000)])
    rng = np.random.default_rng(seed)
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.p.items()}
    per_epoch = -(-len(docs) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    step, total = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            chosen = order[at:at + batch]
            ids, owner = windows_of([docs[k] for k in chosen])
            pick = np.concatenate([rng.permutation(np.flatnonzero(owner == k))[:train_windows] for k in range(len(chosen))])
            pick.sort()
            ids, owner = ids[pick], owner[pick]
            used, inverse = np.unique(ids[ids >= 0], return_inverse=True)
            if not len(used):
                continue
            local = np.full(ids.shape, -1, np.int64)
            local[ids >= 0] = inverse
            feats = some(known, used)
            vectors = net.embed(feats)
            gates = net.project(vectors)
            logit = net.forward(gates, local)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            worst = np.array([a + logit[a:b].argmax() for a, b in zip(starts, np.append(starts[1:], len(owner)))])
            g, _ = net.gradient(feats, vectors, gates, local[worst], y[chosen])
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.9 * step / total) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
            for n, v in net.p.items():
                m, s = moments[n]
                m += 0.1 * (g[n] - m)
                s += 0.001 * (g[n] * g[n] - s)
                v -= lr * m / (np.sqrt(s) + 1e-8)
                if v.shape[0] == BUCKETS:
                    v *= 1 - rate * 0.02  # decay keeps words that were seen once small
    return net


class Scorer:
    """A network in a task: the gates of words met before are kept, up to the vocabulary's limit."""

    def __init__(self, net: Network, window_batch: int = 4096):
        self.net, self.words, self.batch = net, Vocabulary(), window_batch
        self.clear()

    def clear(self):
        self.words.clear()
        self.gates = self.net.project(np.zeros((0, self.net.p["in_f"].shape[0]), np.float32))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        if len(self.words.number) > self.words.limit:
            self.clear()
        docs = [np.array(self.words.ids(t), np.int64) for t in texts]
        new = self.words.new_words()
        for at in range(0, len(new), 20_000):
            more = self.net.project(self.net.embed(features(new[at:at + 20_000])))
            self.gates = {d: np.concatenate([self.gates[d][:-1], more[d]]) for d in "fb"}
        worst = np.full(len(docs), -np.inf, np.float64)
        ids, owner = windows_of(docs)
        for at in range(0, len(ids), self.batch):
            logit = self.net.forward(self.gates, ids[at:at + self.batch])
            np.maximum.at(worst, owner[at:at + self.batch], logit)
        return sigmoid(worst)


# ------------------------------------------------------------------- on Spark

def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def fit(docs: DataFrame, labels: DataFrame, max_pos: int = 1500, max_neg: int = 3000, **training) -> Network:
    """A network trained on the labelled rows of ``docs`` outside the held-out third (see above)."""
    marks = (labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
             .where(remainder() != 1).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = (marks.where("y = 1").orderBy(*order).limit(max_pos)
              .union(marks.where("y = 0").orderBy(*order).limit(max_neg)))
    # at most max_pos + max_neg small rows
    ids = materialize(sample).df
    rows = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")
            .groupBy("doc_id").agg(F.first("text").alias("text"), F.first("y").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    return train([r["text"] for r in rows], [r["y"] for r in rows], **training)


def score(docs: DataFrame, net: Network, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 in ``out_col``."""
    names, sent = docs.columns, docs.sparkSession.sparkContext.broadcast(net)
    at = [n.lower() for n in names].index(text_col.lower())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out_col}` double"
    ready: list[Scorer] = []

    def work(batch):
        if not ready:
            ready.append(Scorer(sent.value))
        scores = ready[0].scores(batch.column(at).to_pylist())
        return {**{n: batch.column(i) for i, n in enumerate(names)}, out_col: np.asarray(scores, np.float64)}

    return arrow_rows(docs, schema, work, batch_chars=1_500_000)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(remainder() == 1, F.lit(False))
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score",
                                   (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. Learns from the labelled ones among ``docs``."""
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = fresh("score", docs.columns)
    return score(docs, net, out_col=out).where(F.col(f"`{out}`") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
