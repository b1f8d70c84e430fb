"""Edge tables between the sampled actors and repositories.

``actors`` / ``repos`` are the node key sets (``actor_set(sample)``,
``repo_set(sample)``), as DataFrames or ``Sized``. Edge events are filtered by
platform, type family and the config window, then semi-joined to both node
sets; the smaller repository set is applied first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.columns import item_key, windowed_rows
from ..functions.joins import Sized, as_frame, restrict_to
from .cohort import star_events

PR_KEY = "pr_id"
ISSUE_KEY = "issue_id"


def star_edges(windowed_sample: DataFrame | Sized) -> DataFrame:
    """Distinct (actor, repo) pairs of the windowed star sample."""
    return as_frame(windowed_sample).select("actor_id", "repo_id").distinct()


def _between_nodes(events: DataFrame, actors: DataFrame | Sized, repos: DataFrame | Sized,
                   cfg: ExtractConfig) -> DataFrame:
    events = restrict_to(events, repos, "repo_id", cfg.broadcast_max_rows)
    return restrict_to(events, actors, "actor_id", cfg.broadcast_max_rows)


def _edge_events(act: DataFrame, types: Sequence[str], cfg: ExtractConfig) -> DataFrame:
    return act.filter((F.col("platform") == cfg.platform)
                      & F.col("type").isin(list(types))
                      & windowed_rows(act, cfg.start, cfg.end))


def fork_edges(act: DataFrame, actors: DataFrame | Sized, repos: DataFrame | Sized,
               cfg: ExtractConfig) -> DataFrame:
    """Distinct (actor, repo) fork events in the window with both ends in the node sets.

    The pair itself need not be a sampled star: any sampled actor forking any
    sampled repository counts.
    """
    forks = _edge_events(act, cfg.fork_types, cfg).select("actor_id", "repo_id")
    return _between_nodes(forks, actors, repos, cfg).distinct()


def item_events(act: DataFrame, actors: DataFrame | Sized, repos: DataFrame | Sized,
                types: Sequence[str], cfg: ExtractConfig, key: str) -> DataFrame:
    """In-window events of one family between the node sets, keyed ``repo_id#issue_number``.

    An event without a number gets a NULL key (such events group together),
    unless ``cfg.drop_null_items`` drops them.
    """
    ev = _edge_events(act, types, cfg).select("actor_id", "repo_id", "issue_number")
    if cfg.drop_null_items:
        ev = ev.filter(F.col("issue_number").isNotNull())
    ev = _between_nodes(ev, actors, repos, cfg)
    return ev.select("actor_id", "repo_id", item_key().alias(key))


def item_weights(items: DataFrame, key: str) -> DataFrame:
    """Number of events per (actor, repo, item) as ``weight``.

    The count is aggregated map-side before the shuffle, so a hot actor or
    item costs one partial row per task.
    """
    return (items.groupBy("actor_id", "repo_id", key).agg(F.count(F.lit(1)).alias("weight"))
            .select("actor_id", "repo_id", key, "weight"))


def weighted_edges(items: DataFrame, key: str, with_repo: bool) -> DataFrame:
    """``item_weights`` with or without the repository."""
    out = item_weights(items, key)
    return out if with_repo else out.drop("repo_id")


def membership(items: DataFrame, key: str) -> DataFrame:
    """Distinct (item, repo) pairs, of item events or of their weights."""
    return items.select(key, "repo_id").distinct()


def pr_events(act, actors, repos, cfg: ExtractConfig) -> DataFrame:
    return item_events(act, actors, repos, cfg.pr_types, cfg, PR_KEY)


def issue_events(act, actors, repos, cfg: ExtractConfig) -> DataFrame:
    return item_events(act, actors, repos, cfg.issue_types, cfg, ISSUE_KEY)


def pr_edges(act, actors, repos, cfg: ExtractConfig, with_repo: bool = False) -> DataFrame:
    """actor -> pull request edges weighted by event count (optionally with repo_id)."""
    return weighted_edges(pr_events(act, actors, repos, cfg), PR_KEY, with_repo)


def issue_edges(act, actors, repos, cfg: ExtractConfig, with_repo: bool = False) -> DataFrame:
    """actor -> issue edges weighted by event count (optionally with repo_id)."""
    return weighted_edges(issue_events(act, actors, repos, cfg), ISSUE_KEY, with_repo)


def pr_membership(act, actors, repos, cfg: ExtractConfig) -> DataFrame:
    """pull request -> repository membership."""
    return membership(pr_events(act, actors, repos, cfg), PR_KEY)


def issue_membership(act, actors, repos, cfg: ExtractConfig) -> DataFrame:
    """issue -> repository membership."""
    return membership(issue_events(act, actors, repos, cfg), ISSUE_KEY)


def stars_per_actor(act: DataFrame, cand: DataFrame | Sized, cfg: ExtractConfig,
                    windowed: bool = True) -> DataFrame:
    """Number of distinct starred candidate repositories per actor.

    Counted over every (in-window) star event of the candidates, before the
    per-repository cap, as the source's diagnostic query does.
    """
    stars = restrict_to(star_events(act, cfg, windowed).select("actor_id", "repo_id"), cand, "repo_id",
                        cfg.broadcast_max_rows)
    return stars.groupBy("actor_id").agg(F.count_distinct("repo_id").alias("starred_repos"))
