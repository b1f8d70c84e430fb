"""cohortgraph: activity-graph extraction on Spark.

Ranks repositories by average score in a time window, adds a pinned list,
samples the newest star events per repository, and derives actor/repository
nodes, star, fork, pull-request and issue edges, membership edges and node
features as lazy DataFrames.
"""

from .config import ExtractConfig
from .plans.graph import build_cohort, extract_graph, publish_graph, read_graph, write_graph

__all__ = ["ExtractConfig", "build_cohort", "extract_graph", "publish_graph", "read_graph", "write_graph"]
