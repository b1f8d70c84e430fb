"""An adaptive range coder for token ids that mixes order-2, order-1 and order-0 predictions.

A block's ids are dealt into lanes of consecutive ids that advance together,
one id per lane and step, and share one model; numpy works on all lanes at
once. Per id the model holds

* order 2 and order 1: the id that last proved right after the two ids, or
  the one id, before, with a confidence from 0 to 3;
* order 0: adaptive frequencies of the ids that neither predicted;
* the mixing weights: for each pair of confidences (and whether both predict
  the same), adaptive frequencies of "order 2 is right", "order 1 is right",
  "neither".

So P(id) = w2 [id = q2] + w1 [id = q1] + w0 P0(id), and this P drives one
arithmetic coding step: the coder narrows its 64-bit interval first to the
weight's share and then, for order 0, to the id's share. All updates follow a
step, from ids that the decoder has by then as well; predictions change after every
step, weights after ``REWEIGH`` steps, order 0 after ``REBUILD`` steps and ever more. An interval below
2^32 puts out its upper 32 bits, once a step at most: a step takes at most
``SHARE`` + ``ZERO`` = 32 bits. Nothing is carried from one block to another.

Block layout (little-endian): ids u32, lanes u32, words u32, crc32 of the ids
as u32 values, crc32 of what follows; then one u16 word count per lane, and the
lanes' u32 words one after another.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, LEAST = 4096, 32  # most lanes; least ids per lane
REBUILD, REWEIGH = 8, 4  # least steps between two order-0 tables, and steps between two sets of weights
HASH_BITS = 17
WORD, LOW, ONE = np.uint64(32), np.uint64((1 << 32) - 1), np.uint64(1)
GAIN, LIMIT = 24.0, 1 << 11
SHARE, ZERO = 12, 20  # bits of the mixing weights' and of order 0's shares
SHARE_BITS, ZERO_BITS, LAST_SHARE = np.uint64(SHARE), np.uint64(ZERO), np.uint64((1 << ZERO) - 1)
HEAD = struct.Struct("<IIIII")


class Model:
    """The shared state of a block's lanes, and what it predicts.

    A prediction and its confidence are one number: id * 4 + confidence. A context is
    the confidences of order 2 and 1 and whether both predict the same, times 4; the kind
    (0: order 2 is right, 1: order 1, 2: neither) is added to it.
    """

    def __init__(self, vocabulary: int, decoder: bool = False):
        if vocabulary >= 1 << ZERO:
            raise ValueError("the vocabulary is too large for order 0's shares")
        self.right = np.zeros(vocabulary + (1 << HASH_BITS), np.int64)  # order 1, then order 2
        self.vocabulary = vocabulary
        self.seen, self.start = np.ones(vocabulary), np.zeros(vocabulary + 1, np.uint64)
        self.floor = np.arange(1, vocabulary + 1)  # every id has a share above 0
        self.id_of = np.arange(vocabulary, dtype=np.int32) if decoder else None
        self.weights = np.full((32, 3), 8, np.int64)
        self.steps = 0
        self.kinds: list[np.ndarray] = []
        self.unpredicted: list[np.ndarray] = []
        self.share()

    def share(self) -> None:
        """The weights as shares of 1 << SHARE: by context + kind, with the borders between them."""
        border = np.zeros((32, 5), np.int64)
        np.cumsum(self.weights, axis=1, out=border[:, 1:4])
        border = (border << SHARE) // border[:, 3:4]  # every weight stays above 0: see LIMIT
        border[:, 4] = 1 << SHARE
        self.before = border[:, :4].astype(np.uint64).ravel()
        self.weight = (border[:, 1:] - border[:, :4]).astype(np.uint64).ravel()

    def refresh(self) -> None:
        """Bring weights and order 0 up to date when they are due."""
        if self.kinds and self.steps % REWEIGH == 0:
            counts = np.bincount(np.concatenate(self.kinds), minlength=128)
            self.kinds = []
            self.weights += counts.reshape(32, 4)[:, :3]
            while (big := self.weights.sum(axis=1) > LIMIT).any():
                self.weights[big] = (self.weights[big] + 1) >> 1
            self.share()
        if self.steps % max(REBUILD, 1 << self.steps.bit_length() >> 2) == 0:
            if self.unpredicted:
                np.add.at(self.seen, np.concatenate(self.unpredicted), GAIN)
                self.unpredicted = []
            cumulated = np.cumsum(self.seen)
            cumulated *= ((1 << ZERO) - len(self.seen)) / cumulated[-1]
            whole = cumulated.astype(np.int64)
            whole[-1] = (1 << ZERO) - len(self.seen)
            self.start[1:] = whole + self.floor
            self.freq = np.diff(self.start)
            if self.id_of is not None:
                self.found = np.repeat(self.id_of, self.freq.astype(np.int64))
        self.steps += 1

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The contexts after ids b, a."""
        self.refresh()
        at = self.at = np.empty((2, len(a)), np.int64)
        at[0] = a
        hashed = at[1]
        np.multiply(b, 40503, out=hashed)
        hashed += a
        hashed *= 2654435761
        hashed >>= 11
        hashed &= (1 << HASH_BITS) - 1
        hashed += self.vocabulary
        p = self.p = self.right.take(at)
        self.k = p & 3
        context = self.k[1] << 2
        context += self.k[0]
        context <<= 1
        context += (p[0] ^ p[1]) < 4
        context <<= 2
        return context

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Which predictions are right: order 1's, order 2's."""
        self.fresh = ids << 2
        return (self.p ^ self.fresh) < 4

    def learn(self, hits, at, inner) -> None:
        """Take in what was right, the contexts + kinds, and the ids that neither order predicted.

        A right prediction gains confidence; a wrong one loses some, and its place once it has none.
        """
        k = self.k
        k <<= 1
        k += hits
        p = self.p
        p += STEP.take(k)
        self.right[self.at] = np.where(k == 0, self.fresh, p)
        self.unpredicted.append(inner)
        self.kinds.append(at)


#: By confidence * 2 + (was it right): what is added to the prediction.
STEP = np.array([0, 1, -1, 1, -1, 1, -1, 0])


def shape(n: int) -> tuple[int, int]:
    """(lanes, ids per lane) of a block of ``n`` ids; the last lanes may have fewer."""
    lanes = max(1, min(LANES, n // LEAST))
    return lanes, max(1, -(-n // lanes))


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    n, model = len(ids), Model(vocabulary)
    lanes, steps = shape(n)
    dealt = np.zeros(lanes * steps, np.int64)
    dealt[:n] = ids
    dealt = np.ascontiguousarray(dealt.reshape(lanes, steps).T)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    words = np.zeros((lanes, steps + 1), np.uint32)
    flat = words.ravel()
    first = np.arange(lanes) * words.shape[1]
    used = first.copy()
    a, b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(steps):
        on = -(-(n - t) // steps)  # the lanes that still have an id: the first ones
        s, lo, wd = dealt[t, :on], low[:on], width[:on]
        at = model.look(a[:on], b[:on])
        hits = model.hits(s)
        not2 = ~hits[1]
        neither = not2 > hits[0]
        at += neither
        at += not2
        wd >>= SHARE_BITS
        lo += wd * model.before.take(at)
        wd *= model.weight.take(at)
        rest = np.flatnonzero(neither)
        part, inner = wd.take(rest) >> ZERO_BITS, s.take(rest)
        lo[rest] += part * model.start.take(inner)
        wd[rest] = part * model.freq.take(inner)
        out, l, w = _ready(lo, wd)
        to = used.take(out)
        flat[to] = l >> WORD
        used[out] = to + 1
        lo[out], wd[out] = l << WORD, w << WORD
        model.learn(hits, at, inner)
        b[:on], a[:on] = a[:on], s
    # one word names a point inside the last interval
    flat[used] = (low + LOW) >> WORD
    used += 1 - first
    data = used.astype("<u2").tobytes() + words[np.arange(words.shape[1]) < used[:, None]].astype("<u4").tobytes()
    return HEAD.pack(n, lanes, int(used.sum()), zlib.crc32(np.asarray(ids, "<u4").tobytes()), zlib.crc32(data)) + data


def _ready(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lanes that put out a word, with their intervals; an interval that straddles two words is cut at the border."""
    at = np.flatnonzero(width <= LOW)
    l, w = low.take(at), width.take(at)
    np.minimum(w, (LOW - (l & LOW)) + ONE, out=w)
    return at, l, w


def decode_block(data: bytes, at: int, vocabulary: int) -> tuple[np.ndarray, int]:
    """(the ids, the place after the block); raises ValueError if a checksum is wrong."""
    n, lanes, total, ids_crc, data_crc = HEAD.unpack_from(data, at)
    at += HEAD.size
    end = at + 2 * lanes + 4 * total
    if zlib.crc32(data[at:end]) != data_crc:
        raise ValueError("a block is damaged")
    used = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
    # what a lane reads beyond its words is 0
    words = np.zeros((lanes, int(used.max()) + 2), np.uint64)
    words[np.arange(words.shape[1]) < used[:, None]] = np.frombuffer(data, "<u4", total, at + 2 * lanes)
    _, steps = shape(n)
    model, out = Model(vocabulary, decoder=True), np.zeros((steps, lanes), np.int64)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    code = words[:, 0] << WORD | words[:, 1]
    flat, read = words.ravel(), np.arange(lanes) * words.shape[1] + 2
    a, b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(steps):
        on = -(-(n - t) // steps)
        lo, wd, cd = low[:on], width[:on], code[:on]
        at = model.look(a[:on], b[:on])
        wd >>= SHARE_BITS
        value = cd - lo  # compared with wd * border: no division
        not2 = value >= wd * model.before.take(at + 1)
        neither = value >= wd * model.before.take(at + 2)
        at += not2
        at += neither
        lo += wd * model.before.take(at)
        wd *= model.weight.take(at)
        s = np.where(not2, model.p[0], model.p[1])
        s >>= 2
        rest = np.flatnonzero(neither)
        part = wd.take(rest) >> ZERO_BITS
        inside = lo.take(rest)
        value = np.minimum((cd.take(rest) - inside) // part, LAST_SHARE)
        inner = model.found.take(value.astype(np.int64)).astype(np.int64)
        s[rest] = inner
        lo[rest] = inside + part * model.start.take(inner)
        wd[rest] = part * model.freq.take(inner)
        into, l, w = _ready(lo, wd)
        frm = read.take(into)
        cd[into] = cd.take(into) << WORD | flat.take(frm)
        read[into] = frm + 1
        lo[into], wd[into] = l << WORD, w << WORD
        model.learn(model.hits(s), at, inner)
        out[t, :on] = s
        b[:on], a[:on] = a[:on], s
    ids = out.T.astype("<u4").ravel()[:n]
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("a block's ids don't match their checksum")
    return ids, end
