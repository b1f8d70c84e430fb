"""Exploration queries over the inputs: profiles, newest scores, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.columns import non_empty


def latest_repo_profile(act: DataFrame, repo_name: str, cfg: ExtractConfig) -> DataFrame:
    """Newest language and topics recorded for one repository name (one row)."""
    return (act.filter((F.col("platform") == cfg.platform) & (F.col("repo_name") == repo_name))
            .orderBy(F.col("created_at").desc(), F.col("event_id").desc())
            .limit(1)
            .select("repo_language", "repo_topics"))


def latest_scores(scores: DataFrame, entity_type: str = "Repo", n: int = 10) -> DataFrame:
    """The ``n`` newest score rows of one entity type (every column kept).

    Ordered newest first; the remaining columns break ties so the chosen rows
    do not depend on task order.
    """
    return (scores.filter(F.col("type") == entity_type)
            .orderBy(F.col("created_at").desc(), F.col("repo_id").asc(), F.col("openrank").desc(),
                     F.col("repo_name").asc(), F.col("org_login").asc(), F.col("platform").asc())
            .limit(n))


def types_with_topics(act: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """Distinct event types whose rows carry a non-empty topic array."""
    return (act.filter((F.col("platform") == cfg.platform) & non_empty("repo_topics"))
            .select("type").distinct())


def table_profile(df: DataFrame) -> DataFrame:
    """Column names and types of an input (``DESCRIBE``)."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "col_name string, data_type string, nullable boolean")
