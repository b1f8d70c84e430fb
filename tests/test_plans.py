"""Plan shape: top-k cut before the shuffle, pushed window bounds, checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from cohortgraph.config import ExtractConfig
from cohortgraph.functions.joins import Sized, materialize
from cohortgraph.functions.topk import top_k_per_group
from cohortgraph.operators import cohort as C
from cohortgraph.operators import edges as E
from cohortgraph.plans.checks import count_nodes, physical_plan, pushed_filters
from cohortgraph.sources.tables import read_activity, read_scores
from tests.conftest import Acts, scores_df, ts


def _parquet_inputs(spark):
    d = tempfile.mkdtemp(prefix="cg-plan-")
    acts = Acts()
    for i in range(50):
        acts.add(i % 7, i % 5, ts(2021 + i % 3, 1 + i % 12), "WatchEvent" if i % 2 else "PullRequestEvent", issue=i)
    acts.df(spark).write.parquet(os.path.join(d, "act"))
    scores_df(spark, [(i % 5, f"r{i % 5}", "o", i, ts(2022, 1 + i % 12)) for i in range(40)]) \
        .write.parquet(os.path.join(d, "scores"))
    return read_scores(spark, os.path.join(d, "scores")), read_activity(spark, os.path.join(d, "act"))


def test_window_bounds_reach_the_scan(spark):
    scores, act = _parquet_inputs(spark)
    cfg = ExtractConfig.for_years(2022, 2023, top_n=3)
    plan = physical_plan(C.top_entities(scores, cfg))
    pushed = " ".join(pushed_filters(plan))
    assert "GreaterThanOrEqual(created_at,2022-01-01" in pushed and "LessThan(created_at,2023-01-01" in pushed
    assert "EqualTo(platform,GitHub)" in pushed
    assert "TakeOrderedAndProject" in plan
    # column pruning: the score scan reads only what the average needs
    assert "ReadSchema: struct<repo_id:bigint,repo_name:string,platform:string,openrank:double," in plan


def test_pinned_filter_reaches_the_scan(spark):
    scores, _ = _parquet_inputs(spark)
    plan = physical_plan(C.pinned_entities(scores, ExtractConfig.for_years(2022, 2023, top_n=3)))
    pushed = " ".join(pushed_filters(plan))
    assert "Or(In(org_login" in pushed and "In(repo_name" in pushed


def test_candidates_have_no_full_sort(spark):
    scores, _ = _parquet_inputs(spark)
    plan = physical_plan(C.candidates(scores, ExtractConfig.for_years(2022, 2023, top_n=3)), "simple")
    assert count_nodes(plan, "Sort") == 0
    assert "rangepartitioning" not in plan


def test_sample_cuts_before_the_shuffle(spark):
    scores, act = _parquet_inputs(spark)
    cfg = ExtractConfig.for_years(2022, 2023, top_n=3, sample_per_repo=4)
    cand = materialize(C.candidates(scores, cfg))
    plan = physical_plan(C.sample_recent(act, cand, cfg), "simple")
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_two_round_top_k_plan(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("t")).repartition(16)
    plan = physical_plan(top_k_per_group(df, ["g"], [F.col("t").desc()], 5, fan_in=4), "simple")
    assert plan.count("Partial") == 2
    assert "hashpartitioning(g#" in plan


def test_group_limit_of_big_k_needs_no_session_change(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cg-plan-"), "t")
    spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("t")).write.parquet(path)
    df = spark.read.parquet(path)  # no static row bound, unlike range()
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    plan = physical_plan(top_k_per_group(df, ["g"], [F.col("t").desc()], 1500, fan_in=1), "simple")
    assert "WindowGroupLimit" in plan
    assert before == (dict(spark.sparkContext.getConf().getAll()),
                      spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def test_broadcast_only_under_the_checked_size(spark):
    scores, act = _parquet_inputs(spark)
    cfg = ExtractConfig.for_years(2022, 2023, top_n=5, sample_per_repo=3)
    cand = materialize(C.candidates(scores, cfg))
    sample = materialize(C.sample_recent(act, cand, cfg))
    actors = Sized(C.actor_set(sample), sample.rows)
    repos = Sized(C.repo_set(sample), sample.rows)
    small = physical_plan(E.pr_edges(act, actors, repos, cfg), "simple")
    assert small.count("BroadcastExchange") >= 2
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = physical_plan(E.pr_edges(act, actors, repos, cfg.with_(broadcast_max_rows=0)), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastExchange" not in big
    assert "SortMergeJoin" in big


def test_materialized_intermediate_is_a_parquet_table(spark):
    df = spark.range(10)
    m = materialize(df)
    assert m.rows == 10
    checkpoint_dir = spark.sparkContext.getCheckpointDir()
    assert m.path.startswith(checkpoint_dir)
    assert "FileScan parquet" in physical_plan(m.df, "simple")


def test_registered_queries_stay_in_the_jvm(spark):
    # no Python evaluation anywhere: every expression is a built-in
    from cohortgraph.plans.registry import QUERIES
    from tests.conftest import SF001

    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                    "PythonUDF", "MapInArrow", "AggregateInPandas", "WindowInPandas")
    for name, q in QUERIES.items():
        plan = physical_plan(q(spark, SF001), "extended")
        assert not any(n in plan for n in python_nodes), name


def test_global_top_n_two_rounds_is_exact(spark):
    from cohortgraph.sources.fixtures import fixture_inputs
    from tests.conftest import SF01

    scores, _, cfg = fixture_inputs(spark, SF01)
    single = C.top_entities(scores, cfg.with_(topn_fan_in=1))
    assert "Window" not in physical_plan(single, "simple")
    for fan_in, offset in ((3, 0), (4, 2)):
        c = cfg.with_(topn_fan_in=fan_in, offset=offset)
        two = C.top_entities(scores, c)
        plan = physical_plan(two, "simple")
        assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan
        want = [tuple(r) for r in C.top_entities(scores, cfg.with_(topn_fan_in=1, offset=offset)).collect()]
        assert [tuple(r) for r in two.collect()] == want
    # the automatic switch: the final merge would exceed the row limit
    assert "WindowGroupLimit" in physical_plan(C.top_entities(scores, cfg.with_(topn_merge_max_rows=10)), "simple")
