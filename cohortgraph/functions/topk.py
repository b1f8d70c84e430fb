"""Exact top-k rows per group, safe for very hot groups.

``row_number() over (partition by g order by o) <= k`` is planned by Catalyst
as Sort -> WindowGroupLimit(Partial) -> Exchange -> WindowGroupLimit(Final):
each map task keeps at most k rows per group before the shuffle. The reducer
of one group then still merges up to ``k * map_tasks`` rows; with one
repository holding a third of a 100 TB log, that is one straggling task.

``top_k_per_group`` therefore ranks in two rounds. Round one partitions by
(group, bucket) with ``bucket = input task id % fan_in``, so the reducer of
(g, b) only hears from ``map_tasks / fan_in`` tasks. Round two ranks the
survivors per group; its map side again keeps k rows per group and task, so
its reducer merges at most ``k * fan_in`` rows. Both rounds are bounded by
``k * max(map_tasks / fan_in, fan_in)``; the default fan-in is
``sqrt(map_tasks)``, with ``map_tasks`` estimated from plan statistics. The
result is exact whatever the buckets are, because the top k of a union is the
top k of the union of per-part top k, provided the order is total (callers
pass a unique tie-break such as ``event_id``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__topk_bucket"


_UNITS = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30,
          "t": 1 << 40, "tb": 1 << 40}


def _bytes(text: str) -> int:
    t = text.strip().lower()
    num = t.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(float(num) * _UNITS.get(t[len(num):] or "b", 1))


def estimated_input_tasks(df: DataFrame) -> int:
    """Scan tasks of the stage that evaluates the bucket, from plan statistics.

    Only planning happens (no job). The bucket is computed in the stage that
    streams the largest input (small sides arrive as broadcasts), so the
    estimate is the largest leaf's ``sizeInBytes`` - the file size for a
    parquet table - over ``spark.sql.files.maxPartitionBytes``. Leaves of
    unknown size are ignored; with none known the default parallelism is used.
    """
    spark = df.sparkSession
    fallback = max(1, spark.sparkContext.defaultParallelism)
    try:
        split = max(1, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")))
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
        largest = 0
        while leaves.hasNext():
            raw = leaves.next().stats().sizeInBytes()  # scala BigInt, or int via py4j
            size = raw if isinstance(raw, int) else int(raw.toString())
            if size < 1 << 62:
                largest = max(largest, size)
    except Exception:
        return fallback
    if largest <= 0:
        return fallback
    return max(1, -(-largest // split))


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], k: int,
                    rank_col: str = "rn", fan_in: int | None = None) -> DataFrame:
    """Keep the first ``k`` rows of each group under ``order_cols``; adds ``rank_col`` (1..k)."""
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    if fan_in is None:
        fan_in = int(math.isqrt(estimated_input_tasks(df)))
    if fan_in > 1:
        bucketed = df.withColumn(_BUCKET, F.spark_partition_id() % F.lit(fan_in))
        w1 = Window.partitionBy(*group_cols, _BUCKET).orderBy(*order_cols)
        df = (bucketed.withColumn(rank_col, F.row_number().over(w1))
              .filter(F.col(rank_col) <= k)
              .drop(rank_col, _BUCKET))
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
