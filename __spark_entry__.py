"""

``queries()`` maps each operator of the extraction to a callable
``(spark, sf_dir) -> DataFrame`` that derives the two logical inputs from the
whole driver tables (see ``cohortgraph.sources.fixtures``) and runs it.
``oracle_sql()`` gives, per key, DuckDB SQL computing the same result from the
same driver tables, written independently of the Spark code: it re-derives
``activity`` / ``rank_scores`` with the FIXTURES.md rule in SQL, with the
parameters of FIXTURES.md written out, and then applies the operator's
semantics directly. Both are the same for every folder.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# the package sits next to this file; make it importable however this module is loaded
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from cohortgraph.plans.registry import QUERIES  # noqa: E402

try:  # the training-data operators and their pipeline are an optional part
    import corpus_pipeline
    from cohortgraph.llm.queries import ORACLES as LLM_ORACLES
    from cohortgraph.llm.queries import QUERIES as LLM_QUERIES
except ImportError as missing:
    if missing.name not in ("corpus_pipeline", "cohortgraph.llm", "cohortgraph.llm.queries"):
        raise  # the part is there, but something in it is broken
    LLM_ORACLES, LLM_QUERIES = {}, {}
else:
    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        LLM_ORACLES = {**LLM_ORACLES, "pipeline": corpus_pipeline.ORACLE_SQL}

FLAGSHIP_SF_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: weighted actor -> pull-request edges on sf0.001."""
    return QUERIES["pr_edges"](spark, FLAGSHIP_SF_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **LLM_QUERIES}


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

WINDOW = "created_at >= TIMESTAMP '1998-01-01 00:00:00' AND created_at < TIMESTAMP '1999-01-01 00:00:00'"
PR = "('PullRequestEvent', 'PullRequestReviewEvent', 'PullRequestReviewCommentEvent')"
ISSUE = "('IssuesEvent', 'IssuesReactionEvent', 'IssueCommentEvent')"


def _items(name: str, key: str, types: str, sample: str) -> str:
    """The events of one family between the nodes of one star sample."""
    return f"""{name} AS (
    SELECT actor_id, repo_id, CAST(repo_id AS VARCHAR) || '#' || CAST(issue_number AS VARCHAR) AS {key}
    FROM gh
    WHERE type IN {types} AND {WINDOW}
      AND actor_id IN (SELECT actor_id FROM {sample}) AND repo_id IN (SELECT repo_id FROM {sample})
)"""


def _features(suffix: str, sample: str) -> str:
    """The feature tables of one star sample."""
    return f"""repo_pr_events{suffix} AS (
    SELECT * FROM gh WHERE type IN {PR} AND repo_id IN (SELECT repo_id FROM {sample})
),
repo_profiles{suffix} AS (
    SELECT repo_id, repo_language, CAST(to_json(repo_topics) AS VARCHAR) AS repo_topics, repo_description
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, event_id DESC) AS r
          FROM repo_pr_events{suffix}) t WHERE r = 1
),
actor_pr_events{suffix} AS (
    SELECT actor_id, repo_language, repo_topics FROM gh
    WHERE type = 'PullRequestEvent' AND actor_id IN (SELECT actor_id FROM {sample})
),
lang_counts{suffix} AS (
    SELECT actor_id, repo_language, count(*) AS language_count
    FROM actor_pr_events{suffix} WHERE repo_language <> '' GROUP BY actor_id, repo_language
),
top_langs{suffix} AS (
    SELECT * FROM (
        SELECT actor_id, repo_language, language_count,
               row_number() OVER (PARTITION BY actor_id ORDER BY language_count DESC, repo_language ASC)
                 AS language_rank
        FROM lang_counts{suffix}) t
    WHERE language_rank <= 3
),
topic_pairs{suffix} AS (
    SELECT DISTINCT actor_id, topic FROM (
        SELECT actor_id, unnest(repo_topics) AS topic FROM actor_pr_events{suffix} WHERE len(repo_topics) > 0) t
    WHERE topic IS NOT NULL
),
actor_profiles{suffix} AS (
    SELECT l.actor_id, CAST(to_json(l.languages) AS VARCHAR) AS languages, CAST(to_json(t.topics) AS VARCHAR) AS topics
    FROM (SELECT actor_id, list_sort(list_distinct(list(repo_language))) AS languages
          FROM top_langs{suffix} GROUP BY actor_id) l
    JOIN (SELECT actor_id, list_sort(list(topic)) AS topics FROM topic_pairs{suffix} GROUP BY actor_id) t
      ON l.actor_id = t.actor_id
)"""


PREFIX = f"""
WITH ev AS (
    SELECT *, CASE WHEN k % 3 = 0 THEN k % 25 ELSE (event_id * 31 + k) % parts END AS repo
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                 (SELECT max(p_partkey) + 1 FROM part) AS parts FROM events) e
),
activity AS (
    SELECT ev.event_id AS event_id,
           ev.user_id AS actor_id,
           ev.repo AS repo_id,
           'repo-' || CAST(ev.repo AS VARCHAR) AS repo_name,
           ev.ts + INTERVAL 1 YEAR * CAST(ev.event_id % 3 - 27 AS INTEGER) AS created_at,
           CASE WHEN ev.event_id % 10 = 9 THEN 'Gitee' ELSE 'GitHub' END AS platform,
           CASE
             WHEN ev.event_type IN ('view', 'signup') THEN 'WatchEvent'
             WHEN ev.event_type = 'purchase' THEN
               CASE WHEN (ev.event_id // 2) % 2 = 0 THEN 'ForkEvent' ELSE 'PushEvent' END
             WHEN ev.event_type = 'click' THEN
               CASE (ev.event_id // 3) % 3 WHEN 0 THEN 'PullRequestEvent'
                    WHEN 1 THEN 'PullRequestReviewEvent' ELSE 'PullRequestReviewCommentEvent' END
             WHEN ev.event_type = 'error' THEN
               CASE (ev.event_id // 3) % 3 WHEN 0 THEN 'IssuesEvent'
                    WHEN 1 THEN 'IssuesReactionEvent' ELSE 'IssueCommentEvent' END
             ELSE ev.event_type
           END AS type,
           CASE WHEN ev.value < 1 THEN NULL ELSE CAST(floor(ev.value) AS BIGINT) % 3 END AS issue_number,
           CASE WHEN p.p_size <= 5 THEN '' ELSE p.p_type END AS repo_language,
           CASE WHEN p.p_size > 45 OR ev.event_type <> 'click' THEN CAST([] AS VARCHAR[])
                ELSE string_split(p.p_name, ' ') END AS repo_topics,
           p.p_brand || ' ' || p.p_name AS repo_description
    FROM ev JOIN part p ON p.p_partkey = (ev.repo + 10 * day(ev.ts)) % ev.parts
),
rank_scores AS (
    SELECT l.l_partkey AS repo_id,
           p.p_brand || '/' || p.p_name
             || CASE WHEN l.l_partkey % 5 = 0 AND l.l_shipdate < TIMESTAMP '1998-07-01 00:00:00'
                     THEN '-old' ELSE '' END AS repo_name,
           p.p_brand AS org_login,
           CASE WHEN l.l_returnflag = 'R' THEN 'Gitee' ELSE 'GitHub' END AS platform,
           CASE WHEN l.l_linestatus = 'F' THEN 'Repo' ELSE 'User' END AS type,
           l.l_extendedprice * CASE WHEN l.l_partkey < 25 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS openrank,
           l.l_shipdate AS created_at
    FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
),
gh AS (SELECT * FROM activity WHERE platform = 'GitHub'),
scores_in_window AS (
    SELECT * FROM rank_scores WHERE platform = 'GitHub' AND {WINDOW}
),
averages AS (
    SELECT repo_id, repo_name, avg(openrank) AS avg_score FROM scores_in_window GROUP BY repo_id, repo_name
),
ranked AS (SELECT * FROM averages ORDER BY avg_score DESC, repo_id ASC, repo_name ASC LIMIT 20),
pinned AS (
    SELECT repo_id, repo_name, avg(openrank) AS avg_score
    FROM scores_in_window
    WHERE org_login IN ('Brand#1', 'Brand#2') OR repo_name IN ('Brand#3/cold rod')
    GROUP BY repo_id, repo_name
),
cand AS (SELECT repo_id FROM ranked UNION SELECT repo_id FROM pinned),
cand_stars AS (
    SELECT actor_id, repo_id, created_at, event_id FROM gh
    WHERE type = 'WatchEvent' AND repo_id IN (SELECT repo_id FROM cand)
),
ranked_stars AS (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, event_id DESC) AS rn
    FROM cand_stars
),
sample AS (SELECT * FROM ranked_stars WHERE rn <= 5),
ranked_stars_w AS (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, event_id DESC) AS rn
    FROM cand_stars WHERE {WINDOW}
),
sample_w AS (SELECT * FROM ranked_stars_w WHERE rn <= 5),
{_items("pr_items", "pr_id", PR, "sample")},
{_items("issue_items", "issue_id", ISSUE, "sample")},
{_items("pr_items_w", "pr_id", PR, "sample_w")},
{_items("issue_items_w", "issue_id", ISSUE, "sample_w")},
forks AS (
    SELECT DISTINCT actor_id, repo_id FROM gh WHERE type = 'ForkEvent' AND {WINDOW}
      AND actor_id IN (SELECT actor_id FROM sample_w) AND repo_id IN (SELECT repo_id FROM sample_w)
),
{_features("", "sample")},
{_features("_w", "sample_w")}
"""


def _graph_nodes(sample: str) -> str:
    return (f"SELECT DISTINCT 'actor' AS kind, actor_id AS id FROM {sample} "
            f"UNION ALL SELECT DISTINCT 'repo', repo_id FROM {sample}")


def _graph_edges(suffix: str) -> str:
    def family(kind: str, table: str, key: str) -> str:
        return f"""
UNION ALL SELECT '{kind}', actor_id, NULL, {key}, count(*) FROM {table} GROUP BY actor_id, repo_id, {key}
UNION ALL SELECT '{kind}_with_repo', actor_id, repo_id, {key}, count(*) FROM {table} GROUP BY actor_id, repo_id, {key}
UNION ALL SELECT DISTINCT '{kind}_in_repo', NULL::BIGINT, repo_id, {key}, NULL::BIGINT FROM {table}"""

    return ("SELECT DISTINCT 'star' AS kind, actor_id, repo_id, NULL::VARCHAR AS item_id, NULL::BIGINT AS weight "
            "FROM sample_w UNION ALL SELECT 'fork', actor_id, repo_id, NULL, NULL FROM forks"
            + family("pr", f"pr_items{suffix}", "pr_id") + family("issue", f"issue_items{suffix}", "issue_id"))


def _graph_features(suffix: str) -> str:
    return ("SELECT 'repo' AS kind, repo_id AS id, repo_language AS languages, repo_topics AS topics, "
            f"repo_description AS description FROM repo_profiles{suffix} "
            f"UNION ALL SELECT 'actor', actor_id, languages, topics, NULL FROM actor_profiles{suffix}")


TAILS = {
    "top_entities": "SELECT repo_id, repo_name, round(avg_score, 6) AS avg_score FROM ranked",
    "top_entities_offset": ("SELECT repo_id, repo_name, round(avg_score, 6) AS avg_score FROM (SELECT * FROM averages "
                            "ORDER BY avg_score DESC, repo_id ASC, repo_name ASC LIMIT 20 OFFSET 7) t"),
    "pinned_entities": "SELECT repo_id, repo_name, round(avg_score, 6) AS avg_score FROM pinned",
    "candidates": "SELECT repo_id FROM cand",
    "star_sample": "SELECT actor_id, repo_id, created_at, event_id, rn FROM sample",
    "star_sample_windowed": "SELECT actor_id, repo_id, created_at, event_id, rn FROM sample_w",
    "actor_nodes": "SELECT DISTINCT actor_id FROM sample",
    "repo_nodes": "SELECT DISTINCT repo_id FROM sample",
    "cohort_counts": ("SELECT count(DISTINCT actor_id) AS actor_count, count(DISTINCT repo_id) AS repo_count "
                      "FROM sample"),
    "star_pairs_unsampled": "SELECT DISTINCT actor_id, repo_id FROM cand_stars",
    "cohort_counts_unsampled": ("SELECT count(DISTINCT actor_id) AS actor_count, "
                                "count(DISTINCT repo_id) AS repo_count FROM cand_stars"),
    "star_edges": "SELECT DISTINCT actor_id, repo_id FROM sample_w",
    "fork_edges": "SELECT actor_id, repo_id FROM forks",
    "pr_edges": "SELECT actor_id, pr_id, count(*) AS weight FROM pr_items GROUP BY actor_id, repo_id, pr_id",
    "pr_edges_with_repo": ("SELECT actor_id, repo_id, pr_id, count(*) AS weight FROM pr_items "
                           "GROUP BY actor_id, repo_id, pr_id"),
    "issue_edges": ("SELECT actor_id, issue_id, count(*) AS weight FROM issue_items "
                    "GROUP BY actor_id, repo_id, issue_id"),
    "issue_edges_with_repo": ("SELECT actor_id, repo_id, issue_id, count(*) AS weight FROM issue_items "
                              "GROUP BY actor_id, repo_id, issue_id"),
    "pr_membership": "SELECT DISTINCT pr_id, repo_id FROM pr_items",
    "issue_membership": "SELECT DISTINCT issue_id, repo_id FROM issue_items",
    "repo_features": "SELECT * FROM repo_profiles",
    "repo_features_non_blank": (
        "SELECT repo_id, repo_language, CAST(to_json(repo_topics) AS VARCHAR) AS repo_topics, repo_description "
        "FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, event_id DESC) AS r "
        "FROM repo_pr_events WHERE len(repo_topics) > 0 OR repo_language <> '') t WHERE r = 1"),
    "repo_feature_count": (
        "SELECT count(*) AS repos_with_features, "
        "CAST(coalesce(sum(informative), 0) AS BIGINT) AS repos_with_topic_or_language FROM ("
        "SELECT repo_id, max(CASE WHEN len(repo_topics) > 0 OR repo_language <> '' THEN 1 ELSE 0 END) "
        "AS informative FROM repo_pr_events GROUP BY repo_id) t"),
    "actor_top_languages": "SELECT actor_id, repo_language, language_count, language_rank FROM top_langs",
    "actor_topics": "SELECT actor_id, topic FROM topic_pairs",
    "actor_features": "SELECT * FROM actor_profiles",
    "actor_history": (
        f"SELECT actor_id, repo_language, CAST(to_json(repo_topics) AS VARCHAR) AS repo_topics FROM gh "
        f"WHERE type IN {PR} AND actor_id = 7"),
    "latest_repo_profile": (
        "SELECT repo_language, CAST(to_json(repo_topics) AS VARCHAR) AS repo_topics FROM gh "
        "WHERE repo_name = 'repo-7' ORDER BY created_at DESC, event_id DESC LIMIT 1"),
    "latest_scores": (
        "SELECT * FROM rank_scores WHERE type = 'Repo' ORDER BY created_at DESC, repo_id ASC, openrank DESC, "
        "repo_name ASC, org_login ASC, platform ASC LIMIT 10"),
    "types_with_topics": "SELECT DISTINCT type FROM gh WHERE len(repo_topics) > 0",
    "stars_per_actor": (
        f"SELECT actor_id, count(DISTINCT repo_id) AS starred_repos FROM cand_stars WHERE {WINDOW} "
        "GROUP BY actor_id"),
    "graph_nodes": _graph_nodes("sample"),
    "graph_nodes_consistent": _graph_nodes("sample_w"),
    "graph_edges": _graph_edges(""),
    "graph_edges_consistent": _graph_edges("_w"),
    "graph_features": _graph_features(""),
    "graph_features_consistent": _graph_features("_w"),
}
# the same look-ups on the log as it is stored
TAILS |= {f"{name}_stored": TAILS[name] for name in ("actor_history", "latest_repo_profile")}
# the same samples from a stored state that took the log in parts
TAILS |= {f"{name}_state": TAILS[name] for name in ("star_sample", "star_sample_windowed")}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per registered key that SQL can express."""
    return {**{name: PREFIX + tail for name, tail in TAILS.items()}, **LLM_ORACLES}


if __name__ == "__main__":  # pragma: no cover - manual smoke run
    from cohortgraph.session import local_session

    s = local_session()
    entry(s).show()
    print(sorted(queries()))
