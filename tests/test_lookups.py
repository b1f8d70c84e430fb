"""Look-ups on a stored log read the row groups that may hold the value, not the table."""

from __future__ import annotations

import random

import pytest

from cohortgraph import ExtractConfig
from cohortgraph.operators import explore as X
from cohortgraph.operators import features as FT
from cohortgraph.sources import read_activity, write_activity
from tests.conftest import Acts, ts

ACTORS, ROWS = 20_000, 40_000
#: As in large row groups: too many values for a dictionary, which a reader would otherwise use.
NO_DICTIONARY = {"parquet.enable.dictionary": "false"}


def scanned_rows(df) -> int:
    """Rows that left the file scans when ``df`` was collected."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan "):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return total


@pytest.fixture(scope="module")
def log(spark):
    """Many actors and names in no order of the storage; some names and actors in a single event."""
    rng, acts = random.Random(5), Acts()
    types = ["PullRequestEvent", "PullRequestReviewEvent", "PullRequestReviewCommentEvent", "WatchEvent"]
    for k in range(ROWS):
        repo = rng.randrange(20_000)
        # a name is shared by repositories that lie far apart
        acts.add(rng.randrange(ACTORS) * 7919, repo, ts(2022, 1 + k % 12, 1 + k % 28, k % 24), type=types[k % 4],
                 lang=rng.choice(["go", "c", ""]), topics=[f"t{k % 50}"] if k % 3 else [], name=f"name-{rng.randrange(20_000)}")
    return acts.df(spark)


@pytest.fixture(scope="module")
def stored(spark, log, tmp_path_factory):
    def write(**options):
        path = str(tmp_path_factory.mktemp("log") / "activity")
        write_activity(log, path, num_partitions=4, row_group_bytes=32_768, **NO_DICTIONARY, **options)
        return read_activity(spark, path)

    return write(), write(lookup_columns=())


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("actor", [7919 * 1234, 7919 * 15_000, 7919 * 9000 + 1])
def test_history_of_one_actor(log, stored, actor):
    cfg = ExtractConfig()
    got, without = (FT.actor_history(t, actor, cfg) for t in stored)
    assert rows(got) == rows(without) == rows(FT.actor_history(log, actor, cfg))
    assert scanned_rows(without) > ROWS / 2
    assert scanned_rows(got) < scanned_rows(without) / 4


@pytest.mark.parametrize("name", ["name-17", "name-18888", "name-1234x"])
def test_newest_profile_of_one_name(log, stored, name):
    cfg = ExtractConfig()
    got, without = (X.latest_repo_profile(t, name, cfg) for t in stored)
    assert rows(got) == rows(without) == rows(X.latest_repo_profile(log, name, cfg))
    assert scanned_rows(got) < scanned_rows(without) / 5
