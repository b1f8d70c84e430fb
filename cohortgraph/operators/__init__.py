"""Graph-extraction operators: each is ``DataFrame(s) + ExtractConfig -> DataFrame``, lazy."""

from .cohort import (actor_nodes, actor_set, candidates, cohort_counts, pinned_entities, repo_nodes,
                     repo_set, sample_recent, star_events, star_pairs_unsampled, top_entities)
from .edges import (fork_edges, issue_edges, issue_events, issue_membership, item_events, membership,
                    pr_edges, pr_events, pr_membership, star_edges, stars_per_actor, weighted_edges)
from .explore import latest_repo_profile, latest_scores, table_profile, types_with_topics
from .features import (actor_feature_events, actor_features, actor_history, actor_language_ranks,
                       actor_topics, repo_feature_count, repo_features)

__all__ = [
    "actor_nodes", "actor_set", "candidates", "cohort_counts", "pinned_entities", "repo_nodes", "repo_set",
    "sample_recent", "star_events", "star_pairs_unsampled", "top_entities",
    "fork_edges", "issue_edges", "issue_events", "issue_membership", "item_events", "membership",
    "pr_edges", "pr_events", "pr_membership", "star_edges", "stars_per_actor", "weighted_edges",
    "latest_repo_profile", "latest_scores", "table_profile", "types_with_topics",
    "actor_feature_events", "actor_features", "actor_history", "actor_language_ranks", "actor_topics",
    "repo_feature_count", "repo_features",
]
