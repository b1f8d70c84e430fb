"""Materialised intermediates and semi joins against key sets of checked size.

A key set (candidate repositories, sampled actors, sampled repositories) is
broadcast only when its row count is known - counted after it was written, or
bounded by a counted parent - and under the configured limit; otherwise the
semi join is left to a shuffle (sort-merge, with adaptive skew splitting of
the big side). Nothing is collected to the driver: only the row count is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

INTERMEDIATE_PREFIX = "cohortgraph"


@dataclass(frozen=True)
class Sized:
    """A DataFrame with an upper bound on its row count (counted after a write, or derived)."""

    df: DataFrame
    rows: int
    path: str | None = None


def materialize(df: DataFrame, partition_by: str | None = None, path: str | None = None) -> Sized:
    """Write ``df`` as a parquet table under the session's checkpoint folder, read it back, count it.

    This cuts the lineage the way a reliable checkpoint does - the files live
    in the shared folder named by ``spark.checkpoint.dir``, so losing an
    executor later does not re-run the upstream scan - while keeping the data
    columnar and giving the planner its real size. The count is an observed
    metric of the write itself; it only feeds size decisions, where an
    over-count (should a retried task ever be counted twice) errs on the safe
    side. With ``partition_by`` each value of that column is a folder. ``path``
    names another folder, which must not exist.
    """
    spark = df.sparkSession
    if path is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{INTERMEDIATE_PREFIX}/{uuid.uuid4().hex}"
    # the row count is observed while the write job runs: no second job
    seen = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    rows = int(seen.get["rows"])
    saved = spark.read.schema(df.schema).parquet(path)
    return Sized(saved, rows, path)


def tighten(keys: Sized, key: str, max_rows: int, store=materialize) -> Sized:
    """An exact count for a key set whose derived bound alone would block a broadcast.

    A bound such as "actors <= sampled events" can be several times the real
    number of distinct keys; when it exceeds ``max_rows`` the distinct keys
    are materialised and counted, so a key set that does fit is still
    broadcast. Key sets already under the limit (or already exact) are kept.
    ``store`` writes and counts them.
    """
    if keys.rows <= max_rows or keys.path is not None:
        return keys
    return store(keys.df.select(key).distinct())


def drop_materialized(spark, items) -> None:
    """Delete the files of materialised intermediates (Hadoop FileSystem API); nothing once the session has ended."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for it in items:
        if isinstance(it, Sized) and it.path:
            p = jvm.org.apache.hadoop.fs.Path(it.path)
            p.getFileSystem(conf).delete(p, True)


def as_frame(x: DataFrame | Sized) -> DataFrame:
    return x.df if isinstance(x, Sized) else x


def key_side(keys: DataFrame | Sized, max_rows: int) -> DataFrame:
    """The key set, with a broadcast hint only when its counted size allows it."""
    if isinstance(keys, Sized):
        return F.broadcast(keys.df) if keys.rows <= max_rows else keys.df
    return keys


def restrict_to(df: DataFrame, keys: DataFrame | Sized, on: str, max_rows: int) -> DataFrame:
    """Rows of ``df`` whose ``on`` value appears in ``keys`` (left semi join)."""
    side = key_side(keys, max_rows).select(on)
    return df.join(side, on=on, how="left_semi")
