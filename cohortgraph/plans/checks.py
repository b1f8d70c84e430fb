"""Plan inspection helpers used by the plan tests and the bench notes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """The text of ``df.explain(mode)``, captured instead of printed."""
    jdf = df._jdf
    return jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def executed_plan(df: DataFrame) -> str:
    """The plan Spark actually ran (after adaptive re-planning); call after an action."""
    return str(df._jdf.queryExecution().executedPlan().toString())


def count_nodes(plan: str, name: str) -> int:
    return len(re.findall(rf"\b{re.escape(name)}\b", plan))


def pushed_filters(plan: str) -> list[str]:
    """The PushedFilters text of every scan (up to the next scan attribute or line end)."""
    return [m.strip() for m in re.findall(r"PushedFilters: \[(.*?)\](?:, ReadSchema|\n|$)", plan)]
