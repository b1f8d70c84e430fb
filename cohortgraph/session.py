"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Session settings the operators rely on. Adaptive execution re-plans joins and
# coalesces small shuffle partitions at runtime; skew-join splits hot keys of
# shuffled joins; ``rn <= k`` is planned as a WindowGroupLimit, which cuts each
# group before the shuffle, only while k is at most the threshold below
# (Spark's default is 1000): raise it for samples of more than a million.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cohortgraph", extra: dict | None = None) -> SparkSession:
    """Local-mode session used by tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable-checkpoint folder, taking it from the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is. Only a local-mode session without one gets a fresh private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortgraph-ckpt-"))
    return sc.getCheckpointDir()
