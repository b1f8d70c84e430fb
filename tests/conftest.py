from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from cohortgraph.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

ACTIVITY_SCHEMA = ("event_id bigint, actor_id bigint, repo_id bigint, repo_name string, created_at timestamp_ntz, "
                   "platform string, type string, issue_number bigint, repo_language string, "
                   "repo_topics array<string>, repo_description string")
SCORE_SCHEMA = ("repo_id bigint, repo_name string, org_login string, platform string, type string, "
                "openrank double, created_at timestamp_ntz")


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="cohortgraph-tests")
    yield s
    s.stop()


def ts(y, m=1, d=1, hh=0, mm=0, ss=0, us=0):
    return datetime(y, m, d, hh, mm, ss, us)


class Acts:
    """Builds activity rows with defaults; event ids are assigned in order."""

    def __init__(self):
        self.rows = []

    def add(self, actor, repo, when, type="WatchEvent", platform="GitHub", issue=None, lang="",
            topics=None, desc="", name=None, event_id=None):
        eid = event_id if event_id is not None else len(self.rows) + 1
        self.rows.append((eid, actor, repo, name or f"r{repo}", when, platform, type, issue, lang,
                          topics if topics is not None else [], desc))
        return self

    def df(self, spark):
        return spark.createDataFrame(self.rows, ACTIVITY_SCHEMA)


def scores_df(spark, rows):
    """rows: (repo_id, repo_name, org_login, openrank, created_at[, platform[, type]])"""
    full = []
    for r in rows:
        repo_id, name, org, score, when = r[:5]
        platform = r[5] if len(r) > 5 else "GitHub"
        typ = r[6] if len(r) > 6 else "Repo"
        full.append((repo_id, name, org, platform, typ, float(score), when))
    return spark.createDataFrame(full, SCORE_SCHEMA)
