"""Derive the two logical inputs from the driver's generated tables.

The driver ships TPC-H-like tables, not a repository score history or a
developer event log. This module maps them (``events`` + ``part`` -> activity,
``lineitem`` + ``part`` -> rank_scores) with the rule written down in
FIXTURES.md, so that every registered query reads whole driver tables and its
work grows with them. The DuckDB oracle in ``__spark_entry__`` applies the same
rule in SQL.

Repository ids are ``part`` keys and range over the whole of ``part``; a third of
the events falls on ``HOT_REPOS`` of them, the rest spreads over all. Both joins
are plain equi-joins on the part key, whose physical form is left to the
optimizer's size estimates.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.columns import ts_literal
from .tables import normalise_activity, normalise_scores

# Fixed values of the fixture mapping (FIXTURES.md).
HOT_REPOS = 25
RENAME_BEFORE = datetime(1998, 7, 1)
WINDOW_START = datetime(1998, 1, 1)
WINDOW_END = datetime(1999, 1, 1)
TOP_N = 20
OFFSET = 0
PINNED_ORGS = ("Brand#1", "Brand#2")
PINNED_NAMES = ("Brand#3/cold rod",)
SAMPLE_PER_REPO = 5  # hot repositories have more stars at every scale
OFFSET_QUERY = 7  # offset of the registered offset query
# drill-down arguments used by the registered exploration queries
HISTORY_ACTOR_ID = 7
PROFILE_REPO_NAME = "repo-7"


def _idiv(name: str, n: int):
    """Integer division (SQL ``div``) of a bigint column by a constant."""
    return F.expr(f"`{name}` div {int(n)}")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    e = F.col("event_id")
    parts = part.agg(F.max("p_partkey") + 1).scalar()  # an uncorrelated scalar subquery
    k = F.get_json_object("props", "$.k").cast("bigint")
    ev = ev.withColumn("_k", k)
    ev = ev.withColumn("_repo", F.when(F.col("_k") % 3 == 0, F.col("_k") % HOT_REPOS)
                       .otherwise((e * 31 + F.col("_k")) % parts))
    # the profile of a repository changes from day to day
    ev = ev.withColumn("_part", (F.col("_repo") + 10 * F.dayofmonth("ts")) % parts)
    joined = ev.join(part, F.col("p_partkey") == F.col("_part"), "inner")
    family = _idiv("event_id", 3) % 3
    etype = F.col("event_type")
    typ = (
        F.when(etype.isin("view", "signup"), F.lit("WatchEvent"))
        .when(etype == "purchase",
              F.when(_idiv("event_id", 2) % 2 == 0, F.lit("ForkEvent")).otherwise(F.lit("PushEvent")))
        .when(etype == "click",
              F.when(family == 0, F.lit("PullRequestEvent"))
              .when(family == 1, F.lit("PullRequestReviewEvent"))
              .otherwise(F.lit("PullRequestReviewCommentEvent")))
        .when(etype == "error",
              F.when(family == 0, F.lit("IssuesEvent"))
              .when(family == 1, F.lit("IssuesReactionEvent"))
              .otherwise(F.lit("IssueCommentEvent")))
        .otherwise(etype)
    )
    repo_id = F.col("_repo")
    raw = joined.select(
        e.alias("event_id"),
        F.col("user_id").alias("actor_id"),
        repo_id.alias("repo_id"),
        F.concat(F.lit("repo-"), repo_id.cast("string")).alias("repo_name"),
        (F.col("ts") + F.make_ym_interval((e % 3 - 27).cast("int"), F.lit(0))).alias("created_at"),
        F.when(e % 10 == 9, F.lit("Gitee")).otherwise(F.lit("GitHub")).alias("platform"),
        typ.alias("type"),
        F.when(F.col("value") < 1, F.lit(None)).otherwise(F.floor("value") % 3).alias("issue_number"),
        F.when(F.col("p_size") <= 5, F.lit("")).otherwise(F.col("p_type")).alias("repo_language"),
        F.when((F.col("p_size") > 45) | (etype != "click"), F.array().cast("array<string>"))
        .otherwise(F.split("p_name", " ")).alias("repo_topics"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("repo_description"),
    )
    return normalise_activity(raw)


def fixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    joined = li.join(part, F.col("p_partkey") == F.col("l_partkey"), "inner")
    repo_id = F.col("l_partkey")
    renamed = (repo_id % 5 == 0) & (F.col("l_shipdate") < ts_literal(RENAME_BEFORE))
    raw = joined.select(
        repo_id.alias("repo_id"),
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"),
                 F.when(renamed, F.lit("-old")).otherwise(F.lit(""))).alias("repo_name"),
        F.col("p_brand").alias("org_login"),
        F.when(F.col("l_returnflag") == "R", F.lit("Gitee")).otherwise(F.lit("GitHub")).alias("platform"),
        F.when(F.col("l_linestatus") == "F", F.lit("Repo")).otherwise(F.lit("User")).alias("type"),
        (F.col("l_extendedprice") * F.when(repo_id < HOT_REPOS, 2.0).otherwise(1.0)).alias("openrank"),
        F.col("l_shipdate").alias("created_at"),
    )
    return normalise_scores(raw)


def fixture_config() -> ExtractConfig:
    """The test configuration of FIXTURES.md, the same for every folder."""
    return ExtractConfig(
        top_n=TOP_N, offset=OFFSET, start=WINDOW_START, end=WINDOW_END, sample_per_repo=SAMPLE_PER_REPO,
        pinned_orgs=PINNED_ORGS, pinned_names=PINNED_NAMES,
    )


def fixture_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ExtractConfig]:
    """(rank_scores, activity, config) for one folder of driver tables; lazy plans, built anew on every call."""
    return fixture_scores(spark, sf_dir), fixture_activity(spark, sf_dir), fixture_config()
