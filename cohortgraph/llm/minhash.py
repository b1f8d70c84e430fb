"""Near-duplicate documents by ProbMinHash: weighted shingles, banding, exact verification.

Shingles are five consecutive words, weighted by how often a document has
them. Every shingle is a Poisson process whose rate is its weight: points
arrive after exponential waiting times and fall on random registers, and a
register keeps the shingle that arrived first. The chance that two documents
agree in a register is their probability Jaccard similarity. A document's
shingles stop producing points once they are later than its latest register
(early termination), so long documents cost about one point per shingle.

Steps
    1. One pass over the documents: a 128-bit key of the text and ``BANDS`` band
       keys of ``ROWS`` registers each. At similarity 0.8 a pair shares no band
       with a chance of (1 - 0.8 ** 6) ** 32, about 6e-5.
    2. Exact copies collapse onto their least doc_id (map-side aggregate).
    3. Different texts that share a band key form a bucket. All members are
       verified against the bucket's least member, and the links' components
       found: a bucket of n near copies costs n verifications, not n * n. Where
       members of a bucket are then in different components, those outside its
       largest component are compared with all members, block by block: pairs
       of different components whose signatures agree in at least ``LIKELY`` of the
       registers (more than four standard errors below 0.8) are compared by
       their shingles, each pair in the first band that it shares. A block returns
       a spanning forest of the links it found, never more rows than members.
       The distance 1 - similarity is a metric, so a pair whose distances to the
       bucket's least member differ by more than 0.2 needs no comparison.
       No bucket is cut or sampled.
    4. Verification computes the probability Jaccard similarity of the full
       shingle sets; links have 0.8 or more.

Defined cases
    * null, empty and blank texts have no shingles and are like nothing, not
      even each other; texts of one to four words are one shingle.
    * rows with a null doc_id are left out (``clusters``) or kept (``stage``).
    * rows that share a doc_id are one document; if their texts differ, one of
      them (of the least key) is compared and all stay or go together.
    * ties: the least doc_id of a cluster is its name and the one that stays.
    * extra columns are not looked at (``clusters``) or kept (``stage``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import Sized, materialize, restrict_to
from .common import WORD, arrow_rows, hash_words, mix64, ngram_hashes, ship, text_key
from .components import components, small

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 32
LIKELY = 0.68
PIVOT_ROWS, MEMBER_ROWS = 512, 2048
BROADCAST_IDS = 2_000_000


# ------------------------------------------------------- shingles and sketches

def shingles(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes in rising order, their counts) of each text; a short text is one shingle."""
    words = [WORD.findall(t) if t else [] for t in texts]
    hashed = hash_words([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        mine = hashed[at:at + len(ws)]
        at += len(ws)
        grams = ngram_hashes(mine, SHINGLE) if len(mine) >= SHINGLE else ngram_hashes(mine, max(1, len(mine)))
        out.append(np.unique(grams.view(np.int64), return_counts=True))
    return out


def sketches(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """The ProbMinHash signature of each weighted set, one row each (zeros for an empty set)."""
    sizes = [len(h) for h, _ in sets]
    first = np.zeros(len(sets) * registers) + np.inf
    winner = np.zeros(len(sets) * registers, np.uint64)
    element = np.concatenate([h for h, _ in sets] or [np.zeros(0, np.int64)]).view(np.uint64)
    rate = np.concatenate([c for _, c in sets] or [np.zeros(0)]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seed, time = element.copy(), np.zeros(len(element))
    while len(element):
        seed = mix64(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log((seed >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / rate
        slot = owner * registers + (mix64(seed ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = element[won]
        late = first.reshape(-1, registers).max(axis=1)
        on = time < late[owner]
        element, rate, owner, seed, time = element[on], rate[on], owner[on], seed[on], time[on]
    return winner.reshape(-1, registers)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for equal registers in different bands."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum over x in both of 1 / sum over y of max(p(y) / p(x), q(y) / q(x)), exactly."""
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    if len(ha) > len(hb):
        (ha, ca), (hb, cb) = (hb, cb), (ha, ca)  # the similarity is symmetric
    to = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    ia = np.flatnonzero(hb[to] == ha)
    ib = to[ia]
    if not len(ia):
        return 0.0
    p, q = ca / ca.sum(), cb / cb.sum()
    px, qx = p[ia], q[ib]
    # sum over y of max(p(y), t q(y)) with t = p(x) / q(x): y only in one set first, then those in both
    t = px / qx
    order = np.argsort(t)
    t_sorted, below = t[order], np.cumsum(qx[order])
    above = np.cumsum(px[order][::-1])[::-1]
    cut = np.searchsorted(t_sorted, t, side="left")
    over = np.append(above, 0.0)[cut]
    under = np.append(0.0, below)[cut]
    total = (p.sum() - px.sum()) + t * (q.sum() - qx.sum()) + over + t * under
    return float((px / total).sum())


# ------------------------------------------------------------------- on Spark

def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy_of, cluster_id): the least doc_id of the same text, and of all linked texts."""
    keyed = (docs.where(F.col(id_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *text_key(F.col(text_col))))

    def work(batch):
        signatures = sketches(shingles(batch.column(1).to_pylist()), BANDS * ROWS)
        short = (mix64(signatures) & np.uint64(255)).astype(np.uint8)
        has = [bool(t and WORD.search(t)) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "k1": batch.column(2), "k2": batch.column(3),
                "bands": [k if h else None for k, h in zip(band_keys(signatures), has)], "sig": [r.tobytes() for r in short]}

    sketched = materialize(arrow_rows(keyed, "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>, sig binary", work)).df
    texts = materialize(sketched.where("bands is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_of"))).df
    member = (sketched.select("doc_id", "k1", "k2").join(texts, ["k1", "k2"], "left")
              .select("doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of")).groupBy("doc_id")
              .agg(F.min("copy_of").alias("copy_of")))
    nodes = texts.groupBy(F.col("copy_of").alias("doc_id")).agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.*")
    banded = materialize(sketched.where("bands is not null").join(nodes, ["doc_id", "k1", "k2"], "left_semi")
                         .select(F.explode("bands").alias("band"), F.col("doc_id").alias("x"))).df
    joined = linked_texts(banded, keyed, nodes, sketched)
    joined = small(joined)
    return (member.join(joined, member["copy_of"] == joined["node"], "left")
            .select("doc_id", "copy_of", F.coalesce("component", "copy_of").alias("cluster_id")))


def linked_texts(banded: DataFrame, keyed: DataFrame, nodes: DataFrame, sketched: DataFrame) -> Sized:
    """(node, component): the components of verified links between texts."""
    buckets = materialize(banded.groupBy("band").agg(F.min("x").alias("first"), F.max("x").alias("last"))
                          .where("first < last").select("band", "first"))
    state = materialize(banded.join(small(buckets), "band")).df
    ids = materialize(state.select(F.col("x").alias("doc_id")).distinct())
    wanted = nodes.join(small(ids), "doc_id", "left_semi")
    texts = restrict_to(keyed, ids, "doc_id", BROADCAST_IDS)
    sets = materialize(shingle_sets(texts.join(wanted, ["doc_id", "k1", "k2"], "left_semi").select("doc_id", "text"))
                       .dropDuplicates(["doc_id"])).df
    seen = materialize(similarity(state.where("x <> first").select("x", F.col("first").alias("p")).distinct(), sets))
    links = seen.df.where(F.col("s") >= THRESHOLD).select("x", "p")
    # of each bucket: its members with their similarity to the first
    state = (state.join(small(seen).select("x", F.col("p").alias("first"), "s"), ["x", "first"], "left")
             .select("band", "x", F.coalesce("s", F.lit(1.0)).alias("s")))
    joined = components(links, "x", "p")
    label = small(joined)
    named = materialize(state.join(label, state["x"] == label["node"], "left").select(
        "band", "x", "s", F.coalesce("component", "x").alias("component"))).df
    sizes = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = materialize(sizes.groupBy("band").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"),
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        .select("band", F.col("top.component").alias("top"),
                F.ceil((F.col("all") - F.col("top.n")) / PIVOT_ROWS).cast("int").alias("n_pb"),
                F.ceil(F.col("all") / MEMBER_ROWS).cast("int").alias("n_mb")))
    if not mixed.rows:
        return joined
    members = named.join(small(mixed), "band")
    ids = materialize(members.select(F.col("x").alias("doc_id")).distinct())
    known = (sketched.join(small(ids), "doc_id", "left_semi").join(nodes, ["doc_id", "k1", "k2"], "left_semi")
             .select("doc_id", "sig", "bands").dropDuplicates(["doc_id"])
             .join(sets.select("doc_id", F.col("hashes").alias("h"), F.col("counts").alias("c")), "doc_id")
             .withColumnRenamed("doc_id", "x"))
    more = materialize(_links_between(members.join(known, "x")))
    if not more.rows:
        return joined
    return components(links.union(more.df), "x", "p")


def _links_between(members: DataFrame) -> DataFrame:
    """(x, p): links that span the components which the members of each bucket still fall into."""
    def deal(parts: str):
        return F.pmod(F.xxhash64(F.lit(1), "x"), F.col(parts)).cast("int")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    columns = ["band", "pb", "mb", "pivot", "x", "component", "s", "sig", "bands", "h", "c"]
    pivots = (members.where("component <> top").withColumn("pb", deal("n_pb")).withColumn("mb", every("n_mb"))
              .withColumn("pivot", F.lit(True)))
    rest = members.withColumn("mb", deal("n_mb")).withColumn("pb", every("n_pb")).withColumn("pivot", F.lit(False))
    ship(members.sparkSession.sparkContext)

    def work(table: pa.Table) -> pa.Table:
        x, p = compare(table)
        return pa.table({"x": pa.array(np.maximum(x, p)), "p": pa.array(np.minimum(x, p))})

    return (pivots.select(*columns).union(rest.select(*columns)).groupBy("band", "pb", "mb")
            .applyInArrow(work, "x bigint, p bigint").distinct())


def compare(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between different components in one block of a bucket.

    Components are united by links only, verified here on the full shingle sets:
    a pair just below the threshold must not hide a link that comes after it.
    """
    pivot = np.array(table.column("pivot").to_pylist(), bool)
    ids, component, s = (table.column(c).to_numpy() for c in ("x", "component", "s"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    band, hashes, counts = table.column("band")[0].as_py(), table.column("h"), table.column("c")
    ps, ms = np.flatnonzero(pivot), np.flatnonzero(~pivot)
    found = [np.zeros((3, 0))]
    for at in range(0, len(ps), 16):
        rows = ps[at:at + 16]
        agree = (sig[rows][:, None, :] == sig[ms][None]).mean(axis=2)
        alike = (agree - 1 / 256) / (1 - 1 / 256)  # registers are compared by one byte
        on = (alike >= LIKELY) & (component[rows][:, None] != component[ms]) & (
            np.abs(s[rows][:, None] - s[ms]) <= 1 - THRESHOLD + 1e-9)
        i, j = np.nonzero(on)
        both = bands[rows[i]] == bands[ms[j]]
        here = bands[rows[i], both.argmax(axis=1)] == band  # the first band they share
        i, j = i[here], j[here]
        found.append(np.stack([alike[i, j], rows[i], ms[j]]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[1:, np.argsort(-pairs[0], kind="stable")].astype(np.int64)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    used = {k: (hashes[k].values.to_numpy(), counts[k].values.to_numpy()) for k in np.unique(pairs).tolist()}
    group, keep = component.tolist(), []
    for k, (i, j) in enumerate(zip(*pairs)):
        a, b = find(group[i]), find(group[j])
        if a == b:
            continue
        x, p = (i, j) if ids[i] > ids[j] else (j, i)  # in the order of similarity(), for the same sum
        if probability_jaccard(used[x], used[p]) >= THRESHOLD:
            root[a] = b
            keep.append(k)
    return ids[pairs[0, keep]], ids[pairs[1, keep]]


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(doc_id, hashes, counts) of (doc_id, text): each text's distinct shingles and how often it has them."""
    def work(batch):
        sets = shingles(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "hashes": [h for h, _ in sets], "counts": [c for _, c in sets]}

    return arrow_rows(texts.select("doc_id", "text"), "doc_id bigint, hashes array<bigint>, counts array<int>", work)


def similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, p, s): the probability Jaccard similarity of each pair of shingle sets."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("hashes").alias(f"h_{name}"), F.col("counts").alias(f"c_{name}"))

    both = pairs.join(side("x"), "x").join(side("p"), "p")

    def work(batch):
        h_x, c_x, h_p, c_p = (batch.column(i) for i in range(2, 6))
        s = [probability_jaccard((hx.values.to_numpy(), cx.values.to_numpy()), (hp.values.to_numpy(), cp.values.to_numpy()))
             for hx, cx, hp, cp in zip(h_x, c_x, h_p, c_p)]
        return {"x": batch.column(0), "p": batch.column(1), "s": s}

    return arrow_rows(both.select("x", "p", "h_x", "c_x", "h_p", "c_p"), "x bigint, p bigint, s double", work)


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clusters(docs).withColumn("kept", F.col("doc_id") == F.col("cluster_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each cluster: the one with the least doc_id."""
    gone = materialize(clusters(docs).where("doc_id <> cluster_id").select("doc_id"))
    return docs.join(small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
