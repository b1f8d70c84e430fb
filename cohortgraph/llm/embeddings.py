"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into two halves, each half has its own codebook, and the
product of the two codebooks is a grid of cells. Every vector lives in the cell
of its two nearest centroids. As a query it visits cells in order of the summed
distances of both halves (the multi-sequence traversal: a heap over pairs of
ranks), up to a margin beyond its own cell; every vector it meets there is
verified by its cosine in double precision.

The codebooks come from at most ``sample`` vectors (those of least hash); their
size follows the number of vectors, so that a cell holds about ``occupancy`` of
them. The margin is set so that ``recall`` of neighbours at exactly the
threshold cosine, drawn at random around the sample, lie in a visited cell. A
pair is found if either of its vectors visits the other's cell, so the reached
recall is higher.

Equal vectors are collapsed first and counted with their multiplicity, so copies
cost nothing. A cell is dealt into blocks of at most about ``home_rows`` vectors
and its visitors into blocks of ``visit_rows``; one task compares one block with
one block by a matrix product, and returns per vector the number of its links
and, for the components, a spanning forest of the links it found: never more
rows than vectors, however many pairs there are.

Defined cases
    * vectors that are null, empty, zero or hold null, NaN or infinite
      components link with nothing; vectors of different lengths don't link.
    * rows that share a vec_id are one vector: that of the least key.
      Null vec_id: the row is left out.
    * ties: the least vec_id names a component.
    * an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import materialize
from .common import arrow_rows
from .components import components

THRESHOLD, RECALL = 0.95, 0.995
SAMPLE, OCCUPANCY = 20_000, 16
HOME_ROWS, VISIT_ROWS = 512, 2048
MOST_CODES = 1024


# ------------------------------------------------------------------- the index

def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = distances(x, centers).argmin(axis=1)
        for d in range(x.shape[1]):
            total = np.bincount(near, weights=x[:, d], minlength=len(centers))
            count = np.bincount(near, minlength=len(centers))
            centers[:, d] = np.where(count > 0, total / np.maximum(count, 1), centers[:, d])
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


class MultiIndex:
    """Two codebooks and the margin up to which cells are visited."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float, occupancy: int = OCCUPANCY):
        half = sample.shape[1] // 2
        self.half = half
        codes = int(min(MOST_CODES, max(1, round((n / occupancy) ** 0.5)), len(sample)))
        self.books = (kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes))
        self.margin = self._margin(sample, threshold, recall)

    def _margin(self, sample: np.ndarray, threshold: float, recall: float) -> float:
        """The quantile of how much farther the cell of a neighbour at the threshold is than the own one."""
        rng = np.random.default_rng(5)
        x = sample[:4000]
        turn = rng.standard_normal(x.shape)
        turn -= (turn * x).sum(1)[:, None] * x
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        y = threshold * x + (1 - threshold ** 2) ** 0.5 * turn
        extra = np.zeros(len(x))
        for part, book in zip((slice(0, self.half), slice(self.half, None)), self.books):
            d = distances(x[:, part], book)
            extra += d[np.arange(len(x)), distances(y[:, part], book).argmin(axis=1)] - d.min(axis=1)
        return float(np.quantile(extra, recall)) if len(extra) else 0.0

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """(own cell of each vector, the cells it visits, nearest first)."""
        da, db = distances(x[:, :self.half], self.books[0]), distances(x[:, self.half:], self.books[1])
        width = len(self.books[1])
        own = da.argmin(1) * width + db.argmin(1)
        return own, [self._visit(a, b, width) for a, b in zip(da, db)]

    def _visit(self, da: np.ndarray, db: np.ndarray, width: int) -> list[int]:
        """Multi-sequence traversal: pairs of ranks by rising sum, each next to one already visited."""
        # each half by its own distance to its nearest centroid, so that rounding never shuts out the own cell
        da, db = da - da.min(), db - db.min()
        ia, ib = np.flatnonzero(da <= self.margin), np.flatnonzero(db <= self.margin)
        ia, ib = ia[np.argsort(da[ia], kind="stable")], ib[np.argsort(db[ib], kind="stable")]
        a, b = da[ia].tolist(), db[ib].tolist()
        heap, out = [(a[0] + b[0], 0, 0)], []
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > self.margin:
                break
            out.append(int(ia[i]) * width + int(ib[j]))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


# ------------------------------------------------------- one block with one block

def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of links that span all links' components (union-find with path halving)."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    keep = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            keep.append(k)
    return keep


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def compare(table: pa.Table, threshold: float) -> dict[str, list]:
    """Links of the visitors with the home vectors of one block of a cell: counts, and a forest of links."""
    home = np.array(table.column("home").to_pylist(), bool)
    ids, weight, own = (table.column(c).to_numpy() for c in ("id", "weight", "own"))
    x = matrix(table.column("vec"))
    v, h = np.flatnonzero(~home), np.flatnonzero(home)
    i, j = np.nonzero(x[v] @ x[h].T >= threshold)
    i, j = v[i], h[j]
    other = ids[i] != ids[j]
    i, j = i[other], j[other]
    n = np.bincount(i, weights=weight[j], minlength=len(ids)).astype(np.int64)
    # a pair whose home vector does not visit the visitor's cell is met only here: count its other side too
    visits = table.column("visits")
    back = {k: set(visits[k].as_py()) for k in np.unique(j).tolist()}
    alone = np.array([c not in back[k] for c, k in zip(own[i].tolist(), j.tolist())], bool)
    n += np.bincount(j[alone], weights=weight[i[alone]], minlength=len(ids)).astype(np.int64)
    got, keep = np.flatnonzero(n), forest(i, j, len(ids))
    return {"id": [*ids[got].tolist(), *ids[i[keep]].tolist()], "n": [*n[got].tolist(), *[0] * len(keep)],
            "linked": [*[None] * len(got), *ids[j[keep]].tolist()]}


# ------------------------------------------------------------------- on Spark

def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
          recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id) of every vector."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    rows = (rows.groupBy("id").agg(F.min("vec").alias("vec"))
            .withColumn("good", F.coalesce(good, F.lit(False)))
            .withColumn("k1", F.xxhash64(F.lit(3), "vec")).withColumn("k2", F.xxhash64(F.lit(5), "vec")))
    rows = materialize(rows).df
    copies = materialize(rows.where("good").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))).df
    single = materialize(rows.where("good").join(copies, (rows["id"] == copies["rep"]) & (rows["k1"] == copies["k1"])
                                                 & (rows["k2"] == copies["k2"]))
                         .select("id", "weight", "vec", F.size("vec").alias("length"))).df
    found = None
    for length, n in sorted(tuple(r) for r in single.groupBy("length").count().collect()):
        if n > 1:  # vectors of another length are not compared
            part = materialize(_pairs(single.where(F.col("length") == length), n, threshold, recall, sample)).df
            found = part if found is None else found.union(part)
    if found is None:
        found = rows.limit(0).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("linked"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.where("linked is not null").select("id", "linked"), "id", "linked").df
    whole = (rows.select("id", "good", "k1", "k2").join(copies, ["k1", "k2"], "left")
             .select("id", F.when(F.col("good"), F.col("rep")).otherwise(F.col("id")).alias("rep"),
                     F.when(F.col("good"), F.col("weight") - 1).otherwise(F.lit(0)).alias("same")))
    return (whole.join(counts.withColumnRenamed("id", "rep"), "rep", "left")
            .join(joined, F.col("rep") == joined["node"], "left")
            .select(F.col("id").alias("vec_id"), (F.col("same") + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
                    F.coalesce("component", "rep").alias("component_id")))


def _pairs(single: DataFrame, n: int, threshold: float, recall: float, sample: int) -> DataFrame:
    """(id, n, linked) from comparing every vector with the cells it visits."""
    spark = single.sparkSession
    drawn = single.orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(sample).select("vec").collect()
    index = spark.sparkContext.broadcast(MultiIndex(unit(np.array([r["vec"] for r in drawn])), n, threshold, recall))

    def place(batch):
        x = unit(matrix(batch.column(2)))
        own, visits = index.value.cells(x)
        return {"id": batch.column(0), "weight": batch.column(1), "own": own, "visits": visits, "vec": list(x)}

    placed = materialize(arrow_rows(single.select("id", "weight", "vec"),
                                    "id bigint, weight bigint, own int, visits array<int>, vec array<double>", place)).df
    homes = placed.groupBy(F.col("own").alias("cell")).agg(F.count(F.lit(1)).alias("n_home"))
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_visit"))
    # at most MOST_CODES ** 2 cells
    cells = F.broadcast(materialize(homes.join(guests, "cell").where("n_visit > 1").select(
        "cell", F.ceil(F.col("n_home") / HOME_ROWS).cast("int").alias("n_hb"),
        F.ceil(F.col("n_visit") / VISIT_ROWS).cast("int").alias("n_vb"))).df)

    def deal(parts: str):
        return F.pmod(F.xxhash64(F.lit(1), "id"), F.col(parts)).cast("int")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    at_home = (placed.withColumn("cell", F.col("own")).join(cells, "cell").withColumn("hb", deal("n_hb"))
               .withColumn("vb", every("n_vb")).withColumn("home", F.lit(True)))
    visiting = (placed.withColumn("cell", F.explode("visits")).withColumn("visits", F.lit(None).cast("array<int>"))
                .join(cells, "cell").withColumn("vb", deal("n_vb")).withColumn("hb", every("n_hb"))
                .withColumn("home", F.lit(False)))
    columns = ["cell", "hb", "vb", "home", "id", "weight", "own", "visits", "vec"]

    def work(table: pa.Table) -> pa.Table:
        return pa.table(compare(table, threshold), schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("linked", pa.int64())]))

    return (at_home.select(*columns).union(visiting.select(*columns)).groupBy("cell", "hb", "vb")
            .applyInArrow(work, "id bigint, n bigint, linked bigint"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def op10_embeddings(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return links(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.a AS vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.a = m.c AS kept
FROM m LEFT JOIN n ON n.a = m.a
"""
