"""Cohort selection: ranked and pinned repositories, the star sample, node sets.

scores = rank_scores, act = activity, cfg = ExtractConfig. Every function is
lazy and returns a DataFrame; key-set arguments may be a plain DataFrame or a
``Sized`` (materialised and counted), in which case small ones are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.columns import in_window, windowed_rows
from ..functions.joins import Sized, as_frame, restrict_to
from ..functions.topk import top_k_per_group

SCORE_COLUMN = "avg_score"


def _scores_in_window(scores: DataFrame, cfg: ExtractConfig) -> DataFrame:
    cond = (F.col("platform") == cfg.platform) & windowed_rows(scores, cfg.start, cfg.end)
    if cfg.entity_type is not None:
        cond = cond & (F.col("type") == cfg.entity_type)
    return scores.filter(cond)


def _average(scores: DataFrame) -> DataFrame:
    # grouped by id AND name: a renamed repository competes under each name
    return scores.groupBy("repo_id", "repo_name").agg(F.avg("openrank").alias(SCORE_COLUMN))


def _topn_fan_in(spark, keep: int, cfg: ExtractConfig) -> int:
    if cfg.topn_fan_in is not None:
        return cfg.topn_fan_in
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return math.isqrt(partitions) if partitions * keep > cfg.topn_merge_max_rows else 1


def top_entities(scores: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """Repositories ranked ``offset .. offset+top_n-1`` by average score in the window.

    Sort + offset + limit is planned as one TakeOrderedAndProject: each task
    keeps its best ``offset + top_n`` rows, so no full sort happens, and one
    task merges those lists. When that merge would exceed
    ``cfg.topn_merge_max_rows`` rows, a first round keeps the best
    ``offset + top_n`` per bucket of aggregate partitions (bucket = partition
    id modulo ``sqrt(partitions)``, cut map-side by WindowGroupLimit) so both
    the bucket tasks and the final merge see about ``sqrt(partitions)`` lists.
    The result is the same: the order is total (score, repo_id, repo_name).
    """
    order = [F.col(SCORE_COLUMN).desc(), F.col("repo_id").asc(), F.col("repo_name").asc()]
    averaged = _average(_scores_in_window(scores, cfg))
    keep = cfg.offset + cfg.top_n
    fan_in = _topn_fan_in(scores.sparkSession, keep, cfg)
    if fan_in > 1 and keep > 0:
        bucketed = averaged.withColumn("_bucket", F.spark_partition_id() % F.lit(fan_in))
        w = Window.partitionBy("_bucket").orderBy(*order)
        averaged = (bucketed.withColumn("_rank", F.row_number().over(w))
                    .filter(F.col("_rank") <= keep).drop("_bucket", "_rank"))
    ranked = averaged.orderBy(*order)
    if cfg.offset:
        ranked = ranked.offset(cfg.offset)
    return ranked.limit(cfg.top_n)


def pinned_entities(scores: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """Average score in the window of the pinned organisations / repository names."""
    return _average(_scores_in_window(scores, cfg).filter(_pinned_row(cfg)))


def _pinned_row(cfg: ExtractConfig):
    return F.col("org_login").isin(list(cfg.pinned_orgs)) | F.col("repo_name").isin(list(cfg.pinned_names))


def candidates(scores: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """Distinct repo_id of the ranked slice together with the pinned repositories.

    The pinned branch keeps its own filter: its ``IN`` predicates on
    org_login / repo_name reach the parquet scan, so it reads only the row
    groups that can hold pinned rows instead of the whole window.
    """
    ranked = top_entities(scores, cfg).select("repo_id")
    pinned = pinned_entities(scores, cfg).select("repo_id")
    return ranked.union(pinned).distinct()


def star_events(act: DataFrame, cfg: ExtractConfig, windowed: bool = False) -> DataFrame:
    cond = (F.col("platform") == cfg.platform) & F.col("type").isin(list(cfg.star_types))
    if windowed:
        cond = cond & windowed_rows(act, cfg.start, cfg.end)
    return act.filter(cond)


def candidate_stars(act: DataFrame, cand: DataFrame | Sized, cfg: ExtractConfig,
                    windowed: bool = False) -> DataFrame:
    """Star events of the candidate repositories: actor_id, repo_id, created_at, event_id."""
    stars = star_events(act, cfg, windowed).select("actor_id", "repo_id", "created_at", "event_id")
    return restrict_to(stars, cand, "repo_id", cfg.broadcast_max_rows)


def newest_per_repo(stars: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """The ``sample_per_repo`` newest rows of each repository (adds ``rn``).

    Ties on ``created_at`` are broken by ``event_id`` (newest id first) so the
    sample is deterministic.
    """
    return top_k_per_group(stars, ["repo_id"], [F.col("created_at").desc(), F.col("event_id").desc()],
                           cfg.sample_per_repo, rank_col="rn", fan_in=cfg.topk_fan_in)


def newest_in_and_out(stars: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """The newest rows of each repository inside the window, and those outside (adds ``in_window``).

    At most ``2 * sample_per_repo`` rows per repository, from which both samples
    follow: the in-window sample is the in-window group, and the all-time
    sample is the newest of both groups together.
    """
    flagged = stars.withColumn("in_window", in_window("created_at", cfg.start, cfg.end))
    return top_k_per_group(flagged, ["repo_id", "in_window"], [F.col("created_at").desc(), F.col("event_id").desc()],
                           cfg.sample_per_repo, rank_col="rn", fan_in=cfg.topk_fan_in)


def sample_recent(act: DataFrame, cand: DataFrame | Sized, cfg: ExtractConfig,
                  windowed: bool = False) -> DataFrame:
    """The ``sample_per_repo`` newest star events of each candidate repository.

    The cap counts events, not actors: an actor who starred twice takes two
    places. ``windowed`` restricts the star events to the config window first
    (the star/fork edge tables use that variant).
    """
    return newest_per_repo(candidate_stars(act, cand, cfg, windowed), cfg)


def actor_set(sample: DataFrame | Sized) -> DataFrame:
    return as_frame(sample).select("actor_id").distinct()


def repo_set(sample: DataFrame | Sized) -> DataFrame:
    return as_frame(sample).select("repo_id").distinct()


def actor_nodes(sample: DataFrame | Sized, ordered: bool = True) -> DataFrame:
    """Distinct sampled actors (presented id-descending)."""
    nodes = actor_set(sample)
    return nodes.orderBy(F.col("actor_id").desc()) if ordered else nodes


def repo_nodes(sample: DataFrame | Sized) -> DataFrame:
    """Distinct repositories with at least one sampled star."""
    return repo_set(sample)


def cohort_counts(pairs: DataFrame | Sized) -> DataFrame:
    """One row: distinct actors and distinct repositories of a sample or pair set."""
    return as_frame(pairs).agg(F.count_distinct("actor_id").alias("actor_count"),
                               F.count_distinct("repo_id").alias("repo_count"))


def star_pairs_unsampled(act: DataFrame, cand: DataFrame | Sized, cfg: ExtractConfig) -> DataFrame:
    """Every distinct (actor, repo) star pair of the candidates, without the per-repo cap."""
    stars = star_events(act, cfg).select("actor_id", "repo_id")
    return restrict_to(stars, cand, "repo_id", cfg.broadcast_max_rows).distinct()
