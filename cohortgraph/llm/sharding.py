"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group; a group goes to one shard. The law is
``bytes``: shards of near-equal size.

Best fit decreasing takes groups by falling size and puts each into the bin
with the least remaining capacity that still holds it, found in a balanced
tree of remaining capacities; if none holds it, a new bin is opened. It runs
in two levels, so that neither a task nor the driver ever sees all groups:

1. Groups are counted and summed map-side by a 128-bit key of their text, and
   dealt over partitions by key. Each task packs its groups, best fit
   decreasing, into parcels of a fixed capacity (1/``FINENESS`` of a shard). A
   larger group is a parcel of its own.
2. The parcels - at most about 2 * ``FINENESS`` * shards, and one more per
   partition, whatever the number of documents - are packed best fit decreasing
   on the driver. A group larger than an equal share of what the larger groups
   leave has a shard of its own. The least capacity for which the other parcels fit
   the remaining shards is found by bisection.

Slots are numbered without gathering a shard: documents are dealt into
buckets by a hash of their doc_id within their shard, numbered inside the bucket,
and shifted by the number of documents in the shard's earlier buckets.

Defined cases
    * null text: size 8 (no bytes), crc32 0; all null texts are one group.
      Empty text: likewise 8 and 0, but a group of its own.
    * null doc_id: the row is sharded like any other.
    * repeated rows are members of one group and take a slot each.
    * ties: equal sizes go by key, equal capacities by the lower bin number;
      equal doc_ids within a bucket by the text's key.
    * an empty table gives no rows; fewer groups than shards leave shards empty.
    * extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import materialize
from .common import ship, text_key

SHARDS, OVERHEAD = 24, 8
FINENESS = 400
BUCKET_ROWS = 2000


# ------------------------------------------------------------ best-fit packing

class CapacityTree:
    """A balanced (AA) tree of (remaining capacity, bin), for the tightest bin that holds a size."""

    def __init__(self):
        self.root = None  # node: [key, level, left, right]

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least entry whose capacity is at least ``size``."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            self.root = self._delete(self.root, found)
        return found

    def _insert(self, node, key):
        if node is None:
            return [key, 1, None, None]
        side = 2 if key < node[0] else 3
        node[side] = self._insert(node[side], key)
        return self._split(self._skew(node))

    def _delete(self, node, key):
        if node is None:
            return None
        if key != node[0]:
            side = 2 if key < node[0] else 3
            node[side] = self._delete(node[side], key)
        elif node[2] is None and node[3] is None:
            return None
        elif node[2] is None:
            node[0] = self._end(node[3], 2)
            node[3] = self._delete(node[3], node[0])
        else:
            node[0] = self._end(node[2], 3)
            node[2] = self._delete(node[2], node[0])
        level = 1 + min(n[1] if n else 0 for n in (node[2], node[3]))
        if level < node[1]:
            node[1] = level
            if node[3] and node[3][1] > level:
                node[3][1] = level
        node = self._skew(node)
        if node[3]:
            node[3] = self._skew(node[3])
            if node[3][3]:
                node[3][3] = self._skew(node[3][3])
        node = self._split(node)
        if node[3]:
            node[3] = self._split(node[3])
        return node

    @staticmethod
    def _end(node, side):
        while node[side]:
            node = node[side]
        return node[0]

    @staticmethod
    def _skew(node):
        left = node[2]
        if left and left[1] == node[1]:
            node[2], left[3] = left[3], node
            return left
        return node

    @staticmethod
    def _split(node):
        right = node[3]
        if right and right[3] and right[3][1] == node[1]:
            node[3], right[2] = right[2], node
            right[1] += 1
            return right
        return node


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size, taken in the given (falling) order; None if ``most`` bins don't do."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if bins == most:
                return None
            found, bins = (max(capacity, size), bins), bins + 1
        out.append(found[1])
        if found[0] > size:
            tree.insert((found[0] - size, found[1]))
    return out


def lone(sizes: list[int], shards: int, rest: int) -> int:
    """How many of the sizes (falling order), ``rest`` in all, exceed an equal share of what the larger ones leave."""
    n = 0
    while n < len(sizes) and sizes[n] * (shards - n) > rest:
        rest, n = rest - sizes[n], n + 1
    return n


def pack(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size (falling order).

    A size larger than an equal share of the rest has a shard of its own; the
    others go to the remaining shards, at the least capacity for which best
    fit needs no more of them.
    """
    own = lone(sizes, shards, sum(sizes))
    sizes, shards = sizes[own:], shards - own
    if not sizes:
        return list(range(own))
    low, high = max(-(-sum(sizes) // shards), sizes[0]), sum(sizes)
    best, exact = [0] * len(sizes), sum(sizes) // shards // 20_000
    # to within a twenty-thousandth of a shard
    while low <= high and (high == sum(sizes) or high - low >= exact):
        mid = (low + high) // 2
        # capacities a thousandth over the ideal nearly always do: look there first
        mid = min(mid, low + max(1, low // 1000)) if high == sum(sizes) else mid
        found = best_fit(sizes, mid, shards)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid - 1
    return [*range(own), *(own + b for b in best)]


# ------------------------------------------------------------------- on Spark

def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, size, text_crc32, shard, slot) of every row."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(text),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    rows = materialize(rows)
    groups = materialize(rows.df.groupBy("k1", "k2").agg(F.sum("size").alias("size"))).df
    total = groups.agg(F.sum("size")).first()[0] or 0
    # groups with a shard of their own (fewer than shards) don't count for the parcels' capacity
    top = [r["size"] for r in groups.select("size").orderBy(F.desc("size")).limit(shards).collect()]
    own = lone(top, shards, total)
    parcel = max(1, (total - sum(top[:own])) // ((shards - own) * FINENESS))
    parcels = materialize(_parcels(groups, parcel)).df
    # bounded: two parcels of one task together exceed the capacity, but for its last
    sums = (parcels.groupBy("task", "parcel").agg(F.sum("size").alias("size"))
            .orderBy(F.desc("size"), "task", "parcel").collect())
    place = pack([r["size"] for r in sums], shards)
    to = docs.sparkSession.createDataFrame(
        [(r["task"], r["parcel"], s) for r, s in zip(sums, place)], "task int, parcel int, shard int")
    group = materialize(parcels.join(F.broadcast(to), ["task", "parcel"]).select("k1", "k2", "shard")).df
    placed = rows.df.join(group, ["k1", "k2"])
    return slots(placed, rows.rows)


def _parcels(groups: DataFrame, capacity: int) -> DataFrame:
    """(k1, k2, size, task, parcel): each task's groups, packed best fit decreasing."""
    ship(groups.sparkSession.sparkContext)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        size, k1, k2 = (table.column(c).to_numpy() for c in ("size", "k1", "k2"))
        order = np.lexsort((k2, k1, -size))
        bins = best_fit(size[order].tolist(), capacity)
        table = table.take(pa.array(order))
        yield from pa.table({"k1": table["k1"], "k2": table["k2"], "size": table["size"],
                             "task": pa.array(np.full(len(bins), task), pa.int32()),
                             "parcel": pa.array(bins, pa.int32())}).to_batches()

    return groups.mapInArrow(run, "k1 bigint, k2 bigint, size bigint, task int, parcel int")


def slots(placed: DataFrame, n_rows: int) -> DataFrame:
    """``placed`` with gapless slot numbers from 0 in each shard, without gathering a shard."""
    buckets = max(64, -(-n_rows // BUCKET_ROWS))
    placed = materialize(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(buckets)).cast("long"))).df
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket, 1 / BUCKET_ROWS of the rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))).df
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "k1", "k2")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    return (numbered.join(starts, ["shard", "bucket"])
            .withColumn("slot", (F.col("start") + F.col("at")).cast("long")).drop("start", "at", "bucket"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))
