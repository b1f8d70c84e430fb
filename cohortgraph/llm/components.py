"""Connected components of a link table by least labels and pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import Sized, materialize


BROADCAST_ROWS = 1_000_000


def small(table: Sized) -> DataFrame:
    """A counted table, broadcast if it is small; beyond that the join shuffles."""
    return F.broadcast(table.df) if table.rows <= BROADCAST_ROWS else table.df


def components(links: DataFrame, a: str, b: str) -> Sized:
    """(node, component): the least node reachable, for every node that has a link.

    Each round every node takes the least label among its neighbours' and its
    own, and then the label of that label; the number of rounds grows with the
    logarithm of a component's diameter in the usual case. Labels are written
    to the checkpoint folder after each round, so no lineage piles up; only
    the number of changed labels comes to the driver.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = both.union(both.select("dst", "src"))
    edges = materialize(both.union(both.select("src", F.col("src").alias("dst"))).distinct()).df  # and each node with itself
    labels = materialize(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component")))
    while True:
        old = small(labels).select(F.col("node").alias("dst"), "component")
        near = materialize(edges.join(old, "dst").groupBy("src").agg(
            F.min("component").alias("near"), F.min(F.when(F.col("src") == F.col("dst"), F.col("component"))).alias("old")))
        up = small(near).select(F.col("src").alias("near"), F.col("near").alias("far"))
        step = materialize(near.df.join(up, "near").select(F.col("src").alias("node"), "old", F.col("far").alias("component")))
        labels = Sized(step.df.select("node", "component"), step.rows, step.path)
        if not step.df.where("old <> component").limit(1).count():
            return labels
