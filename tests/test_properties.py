"""Properties: the two-round top-k against brute force, and graph invariants."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortgraph.functions.joins import materialize
from cohortgraph.functions.topk import estimated_input_tasks, top_k_per_group
from cohortgraph.operators import cohort as C
from cohortgraph.operators import edges as E
from cohortgraph.plans.graph import build_cohort, extract_graph
from cohortgraph.sources.fixtures import fixture_inputs
from cohortgraph.sources.tables import read_activity
from tests.conftest import SF01


def _skewed_rows(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all rows in group 0, the rest spread over 20 groups
        g = 0 if rnd.random() < 1 / 3 else rnd.randint(1, 20)
        rows.append((g, rnd.randint(0, 50), i))  # coarse "time" => many ties, broken by id
    return rows


@pytest.mark.parametrize("seed,k,fan_in,parts", [(1, 5, None, 9), (2, 1, 3, 16), (3, 17, 7, 5), (4, 40, 1, 4)])
def test_top_k_matches_brute_force(spark, seed, k, fan_in, parts):
    rows = _skewed_rows(seed, 3000)
    df = spark.createDataFrame(rows, "g bigint, t bigint, id bigint").repartition(parts)
    got = top_k_per_group(df, ["g"], [F.col("t").desc(), F.col("id").desc()], k, fan_in=fan_in)
    got = sorted((r["g"], r["id"], r["rn"]) for r in got.collect())
    pdf = pd.DataFrame(rows, columns=["g", "t", "id"]).sort_values(["g", "t", "id"], ascending=[True, False, False])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    want = sorted(tuple(int(x) for x in r) for r in pdf[pdf.rn <= k][["g", "id", "rn"]].itertuples(index=False))
    assert got == want


@pytest.fixture(scope="module")
def sf01(spark):
    scores, act, cfg = fixture_inputs(spark, SF01)
    return scores, act, cfg, build_cohort(scores, act, cfg)


def test_sample_is_capped_and_within_candidates(sf01):
    scores, act, cfg, co = sf01
    per_repo = co.sample.df.groupBy("repo_id").count().agg(F.max("count")).first()[0]
    assert per_repo <= cfg.sample_per_repo
    outside = C.repo_nodes(co.sample).join(co.candidates.df, "repo_id", "left_anti").count()
    assert outside == 0


def test_weights_and_membership(sf01):
    scores, act, cfg, co = sf01
    for kind, key in (("pr", E.PR_KEY), ("issue", E.ISSUE_KEY)):
        events = (E.pr_events if kind == "pr" else E.issue_events)(act, co.actors, co.repos, cfg)
        with_repo = E.weighted_edges(events, key, True)
        without = E.weighted_edges(events, key, False)
        assert with_repo.agg(F.sum("weight")).first()[0] == events.count()
        assert sorted(map(tuple, with_repo.drop("repo_id").collect()), key=str) == \
            sorted(map(tuple, without.collect()), key=str)
        member = E.membership(events, key)
        assert member.exceptAll(with_repo.select(key, "repo_id").distinct()).count() == 0
        assert member.count() == with_repo.select(key, "repo_id").distinct().count()


def test_consistent_graph_endpoints_are_nodes(spark):
    scores, act, cfg = fixture_inputs(spark, SF01)
    g = extract_graph(scores, act, cfg, consistent=True)
    actors, repos = g["actor"], g["repo"]
    for name in ("actor_star_repo", "actor_fork_repo", "actor_contribute_pr_belong_repo",
                 "actor_discussion_issue_belong_repo"):
        t = g[name]
        assert t.join(actors, "actor_id", "left_anti").count() == 0, name
        assert t.join(repos, "repo_id", "left_anti").count() == 0, name


def test_two_round_sample_on_many_input_tasks(spark, tmp_path):
    # the fixture activity spread over 16 files, read with small splits: the
    # estimated fan-in is > 1, so the sample takes the two-round path
    scores, act, cfg = fixture_inputs(spark, SF01)
    path = str(tmp_path / "activity")
    act.repartition(16).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        many = read_activity(spark, path)
        assert estimated_input_tasks(many) >= 4
        cand = materialize(C.candidates(scores, cfg))
        two_round = C.sample_recent(many, cand, cfg)
        assert "SPARK_PARTITION_ID" in two_round._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(tuple(r) for r in two_round.select("repo_id", "event_id", "rn").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    one_round = C.sample_recent(act, cand, cfg.with_(topk_fan_in=1))
    want = sorted(tuple(r) for r in one_round.select("repo_id", "event_id", "rn").collect())
    assert got == want and got
