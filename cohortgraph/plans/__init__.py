"""Whole-run plans: the shared cohort, ``extract_graph`` / ``write_graph``, plan checks."""

from .checks import count_nodes, executed_plan, physical_plan, pushed_filters
from .graph import TABLES, Cohort, build_cohort, extract_graph, publish_graph, read_graph, write_graph

__all__ = ["Cohort", "TABLES", "build_cohort", "extract_graph", "publish_graph", "read_graph", "write_graph",
           "count_nodes", "executed_plan", "physical_plan", "pushed_filters"]
