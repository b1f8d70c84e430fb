"""Named queries over a driver scale-factor folder.

Each query takes ``(spark, sf_dir)``, derives ``rank_scores`` / ``activity``
from the whole driver tables (``sources.fixtures``) and runs one operator.
Output columns are aliased to the names the DuckDB oracle uses; averages are
rounded to 6 decimals and array columns rendered as JSON text so values
compare exactly across engines.

The operator queries are one lazy plan each: the cohort is part of it, nothing
is written, and adaptive execution chooses the joins from measured sizes. The
``graph_*`` queries run ``extract_graph``, whose intermediates stay under the
checkpoint folder until the session's Python process ends.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import render_arrays
from ..functions.joins import INTERMEDIATE_PREFIX
from ..operators import cohort as C
from ..operators import edges as E
from ..operators import explore as X
from ..operators import features as FT
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import read_activity, write_activity
from .graph import extract_graph
from .newest_state import StarState

SCORE_DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]


def _round_score(df: DataFrame) -> DataFrame:
    return df.withColumn(C.SCORE_COLUMN, F.round(C.SCORE_COLUMN, SCORE_DIGITS))


class _Cohort(NamedTuple):
    """The star sample and its node key sets, as plans."""

    sample: DataFrame
    actors: DataFrame
    repos: DataFrame


def _cohort(spark, sf_dir, windowed=False):
    scores, act, cfg = FX.fixture_inputs(spark, sf_dir)
    sample = C.sample_recent(act, C.candidates(scores, cfg), cfg, windowed=windowed)
    return act, cfg, _Cohort(sample, C.actor_set(sample), C.repo_set(sample))


def top_entities(spark, sf_dir):
    scores, _, cfg = FX.fixture_inputs(spark, sf_dir)
    return _round_score(C.top_entities(scores, cfg))


def top_entities_offset(spark, sf_dir):
    scores, _, cfg = FX.fixture_inputs(spark, sf_dir)
    return _round_score(C.top_entities(scores, cfg.with_(offset=FX.OFFSET_QUERY)))


def pinned_entities(spark, sf_dir):
    scores, _, cfg = FX.fixture_inputs(spark, sf_dir)
    return _round_score(C.pinned_entities(scores, cfg))


def candidates(spark, sf_dir):
    scores, _, cfg = FX.fixture_inputs(spark, sf_dir)
    return C.candidates(scores, cfg)


def _star_sample(windowed: bool):
    def q(spark, sf_dir):
        _, _, co = _cohort(spark, sf_dir, windowed)
        return co.sample.select("actor_id", "repo_id", "created_at", "event_id", F.col("rn").cast("bigint"))
    return q


def _run_folder(spark) -> str:
    """A new folder of its own under the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{INTERMEDIATE_PREFIX}/{uuid.uuid4().hex}"


def _star_sample_state(windowed: bool):
    """The sample from a stored state that took the whole log in three deliveries, late events among them."""
    def q(spark, sf_dir):
        scores, act, cfg = FX.fixture_inputs(spark, sf_dir)
        folder = _run_folder(spark)
        state = StarState(spark, f"{folder}/state", cfg)
        for delivery in range(3):
            write_activity(act.where(F.col("event_id") % 3 == delivery), f"{folder}/log", mode="append")
            state.ingest(f"{folder}/log")
        sample = state.sample(C.candidates(scores, cfg), windowed)
        return sample.select("actor_id", "repo_id", "created_at", "event_id", F.col("rn").cast("bigint"))
    return q


def actor_nodes(spark, sf_dir):
    _, _, co = _cohort(spark, sf_dir)
    return C.actor_nodes(co.sample)


def repo_nodes(spark, sf_dir):
    _, _, co = _cohort(spark, sf_dir)
    return C.repo_nodes(co.sample)


def cohort_counts(spark, sf_dir):
    _, _, co = _cohort(spark, sf_dir)
    return C.cohort_counts(co.sample)


def star_pairs_unsampled(spark, sf_dir):
    scores, act, cfg = FX.fixture_inputs(spark, sf_dir)
    return C.star_pairs_unsampled(act, C.candidates(scores, cfg), cfg)


def cohort_counts_unsampled(spark, sf_dir):
    return C.cohort_counts(star_pairs_unsampled(spark, sf_dir))


def star_edges(spark, sf_dir):
    _, _, co = _cohort(spark, sf_dir, windowed=True)
    return E.star_edges(co.sample)


def fork_edges(spark, sf_dir):
    act, cfg, co = _cohort(spark, sf_dir, windowed=True)
    return E.fork_edges(act, co.actors, co.repos, cfg)


def _items(kind: str, with_repo: bool | None):
    def q(spark, sf_dir):
        act, cfg, co = _cohort(spark, sf_dir)
        ev = (E.pr_events if kind == "pr" else E.issue_events)(act, co.actors, co.repos, cfg)
        key = E.PR_KEY if kind == "pr" else E.ISSUE_KEY
        if with_repo is None:
            return E.membership(ev, key)
        return E.weighted_edges(ev, key, with_repo)
    return q


def _repo_features(non_blank_only: bool):
    def q(spark, sf_dir):
        act, cfg, co = _cohort(spark, sf_dir)
        return render_arrays(FT.repo_features(act, co.repos, cfg, non_blank_only=non_blank_only), "repo_topics")
    return q


def repo_feature_count(spark, sf_dir):
    act, cfg, co = _cohort(spark, sf_dir)
    return FT.repo_feature_count(act, co.repos, cfg)


def _actor_events(spark, sf_dir):
    act, cfg, co = _cohort(spark, sf_dir)
    return FT.actor_feature_events(act, co.actors, cfg), cfg


def actor_top_languages(spark, sf_dir):
    ev, cfg = _actor_events(spark, sf_dir)
    return FT.actor_language_ranks(ev, cfg).withColumn("language_rank", F.col("language_rank").cast("bigint"))


def actor_topics(spark, sf_dir):
    ev, _ = _actor_events(spark, sf_dir)
    return FT.actor_topics(ev)


def actor_features(spark, sf_dir):
    ev, cfg = _actor_events(spark, sf_dir)
    return render_arrays(FT.actor_features(ev, cfg), "languages", "topics")


def actor_history(spark, sf_dir):
    _, act, cfg = FX.fixture_inputs(spark, sf_dir)
    return render_arrays(FT.actor_history(act, FX.HISTORY_ACTOR_ID, cfg), "repo_topics")


def latest_repo_profile(spark, sf_dir):
    _, act, cfg = FX.fixture_inputs(spark, sf_dir)
    return render_arrays(X.latest_repo_profile(act, FX.PROFILE_REPO_NAME, cfg), "repo_topics")


def _stored(spark, act):
    """``act`` as ``write_activity`` stores it, under the checkpoint folder."""
    path = _run_folder(spark)
    write_activity(act, path)
    return read_activity(spark, path)


def actor_history_stored(spark, sf_dir):
    _, act, cfg = FX.fixture_inputs(spark, sf_dir)
    return render_arrays(FT.actor_history(_stored(spark, act), FX.HISTORY_ACTOR_ID, cfg), "repo_topics")


def latest_repo_profile_stored(spark, sf_dir):
    _, act, cfg = FX.fixture_inputs(spark, sf_dir)
    return render_arrays(X.latest_repo_profile(_stored(spark, act), FX.PROFILE_REPO_NAME, cfg), "repo_topics")


def latest_scores(spark, sf_dir):
    scores, _, _ = FX.fixture_inputs(spark, sf_dir)
    return X.latest_scores(scores, "Repo", 10)


def types_with_topics(spark, sf_dir):
    _, act, cfg = FX.fixture_inputs(spark, sf_dir)
    return X.types_with_topics(act, cfg)


def stars_per_actor(spark, sf_dir):
    scores, act, cfg = FX.fixture_inputs(spark, sf_dir)
    return E.stars_per_actor(act, C.candidates(scores, cfg), cfg)


def _graph(spark, sf_dir, consistent, tables):
    scores, act, cfg = FX.fixture_inputs(spark, sf_dir)
    graph = extract_graph(scores, act, cfg, consistent=consistent, tables=tables)
    atexit.register(graph.release)
    return graph


def _row(kind, *columns):
    """``kind`` and the given (value, name) columns; None stands for an absent value."""
    return [F.lit(kind).alias("kind"), *[(F.lit(None) if c is None else F.col(c)).cast(t).alias(n) for c, n, t in columns]]


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


def _graph_nodes(consistent: bool):
    def q(spark, sf_dir):
        g = _graph(spark, sf_dir, consistent, ("actor", "repo"))
        return _union([g[k].select(*_row(k, (f"{k}_id", "id", "bigint"))) for k in ("actor", "repo")])
    return q


# kind -> (table, its columns for actor, repository, item and weight)
_EDGES = {
    "star": ("actor_star_repo", "actor_id", "repo_id", None, None),
    "fork": ("actor_fork_repo", "actor_id", "repo_id", None, None),
    "pr": ("actor_contribute_pr", "actor_id", None, E.PR_KEY, "weight"),
    "pr_with_repo": ("actor_contribute_pr_belong_repo", "actor_id", "repo_id", E.PR_KEY, "weight"),
    "pr_in_repo": ("pr_belong_repo", None, "repo_id", E.PR_KEY, None),
    "issue": ("actor_discussion_issue", "actor_id", None, E.ISSUE_KEY, "weight"),
    "issue_with_repo": ("actor_discussion_issue_belong_repo", "actor_id", "repo_id", E.ISSUE_KEY, "weight"),
    "issue_in_repo": ("issue_belong_repo", None, "repo_id", E.ISSUE_KEY, None),
}


def _graph_edges(consistent: bool):
    def q(spark, sf_dir):
        g = _graph(spark, sf_dir, consistent, [t for t, *_ in _EDGES.values()])
        return _union([g[t].select(*_row(kind, (a, "actor_id", "bigint"), (r, "repo_id", "bigint"),
                                         (i, "item_id", "string"), (w, "weight", "bigint")))
                       for kind, (t, a, r, i, w) in _EDGES.items()])
    return q


def _graph_features(consistent: bool):
    def q(spark, sf_dir):
        g = _graph(spark, sf_dir, consistent, ("repo_with_feature", "actor_with_feature"))
        repos = render_arrays(g["repo_with_feature"], "repo_topics")
        actors = render_arrays(g["actor_with_feature"], "languages", "topics")
        return _union([
            repos.select(*_row("repo", ("repo_id", "id", "bigint"), ("repo_language", "languages", "string"),
                               ("repo_topics", "topics", "string"), ("repo_description", "description", "string"))),
            actors.select(*_row("actor", ("actor_id", "id", "bigint"), ("languages", "languages", "string"),
                                ("topics", "topics", "string"), (None, "description", "string")))])
    return q


QUERIES: dict[str, Query] = {
    "top_entities": top_entities,
    "top_entities_offset": top_entities_offset,
    "pinned_entities": pinned_entities,
    "candidates": candidates,
    "star_sample": _star_sample(False),
    "star_sample_windowed": _star_sample(True),
    "star_sample_state": _star_sample_state(False),
    "star_sample_windowed_state": _star_sample_state(True),
    "actor_nodes": actor_nodes,
    "repo_nodes": repo_nodes,
    "cohort_counts": cohort_counts,
    "star_pairs_unsampled": star_pairs_unsampled,
    "cohort_counts_unsampled": cohort_counts_unsampled,
    "star_edges": star_edges,
    "fork_edges": fork_edges,
    "pr_edges": _items("pr", False),
    "pr_edges_with_repo": _items("pr", True),
    "issue_edges": _items("issue", False),
    "issue_edges_with_repo": _items("issue", True),
    "pr_membership": _items("pr", None),
    "issue_membership": _items("issue", None),
    "repo_features": _repo_features(False),
    "repo_features_non_blank": _repo_features(True),
    "repo_feature_count": repo_feature_count,
    "actor_top_languages": actor_top_languages,
    "actor_topics": actor_topics,
    "actor_features": actor_features,
    "actor_history": actor_history,
    "latest_repo_profile": latest_repo_profile,
    "actor_history_stored": actor_history_stored,
    "latest_repo_profile_stored": latest_repo_profile_stored,
    "latest_scores": latest_scores,
    "types_with_topics": types_with_topics,
    "stars_per_actor": stars_per_actor,
    "graph_nodes": _graph_nodes(False),
    "graph_nodes_consistent": _graph_nodes(True),
    "graph_edges": _graph_edges(False),
    "graph_edges_consistent": _graph_edges(True),
    "graph_features": _graph_features(False),
    "graph_features_consistent": _graph_features(True),
}
