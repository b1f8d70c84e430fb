"""The shared-cohort pipeline equals the stand-alone operators; sinks round-trip."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortgraph.operators import cohort as C
from cohortgraph.operators import edges as E
from cohortgraph.operators import features as FT
from cohortgraph.plans.graph import build_cohort, extract_graph, write_graph
from cohortgraph.sources.fixtures import fixture_inputs
from cohortgraph.sources.tables import normalise_activity
from tests.conftest import SF001


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def graph(spark):
    scores, act, cfg = fixture_inputs(spark, SF001)
    return scores, act, cfg, extract_graph(scores, act, cfg)


@pytest.mark.parametrize("limit", [None, 1])
def test_graph_tables_equal_standalone_operators(spark, graph, limit):
    scores, act, cfg, g = graph
    if limit:  # node sets over the broadcast limit: shuffle joins, the same passes
        cfg = cfg.with_(broadcast_max_rows=limit)
        g = extract_graph(scores, act, cfg)
    base = build_cohort(scores, act, cfg)
    win = build_cohort(scores, act, cfg, windowed=True)
    expected = {
        "actor": C.actor_nodes(base.sample),
        "repo": C.repo_nodes(base.sample),
        "actor_star_repo": E.star_edges(win.sample),
        "actor_fork_repo": E.fork_edges(act, win.actors, win.repos, cfg),
        "actor_contribute_pr": E.pr_edges(act, base.actors, base.repos, cfg),
        "actor_contribute_pr_belong_repo": E.pr_edges(act, base.actors, base.repos, cfg, with_repo=True),
        "actor_discussion_issue": E.issue_edges(act, base.actors, base.repos, cfg),
        "actor_discussion_issue_belong_repo": E.issue_edges(act, base.actors, base.repos, cfg, with_repo=True),
        "pr_belong_repo": E.pr_membership(act, base.actors, base.repos, cfg),
        "issue_belong_repo": E.issue_membership(act, base.actors, base.repos, cfg),
        "repo_with_feature": FT.repo_features(act, base.repos, cfg),
        "actor_with_feature": FT.actor_features(FT.actor_feature_events(act, base.actors, cfg), cfg),
    }
    assert set(g) == set(expected)
    for name, df in expected.items():
        assert g[name].columns == df.columns, name
        assert _rows(g[name]) == _rows(df), name


def test_write_graph_parquet_and_csv(spark, graph):
    _, _, _, g = graph
    out = tempfile.mkdtemp(prefix="cg-graph-")
    paths = write_graph(g, os.path.join(out, "pq"))
    for name, p in paths.items():
        assert spark.read.parquet(p).count() == g[name].count(), name
    with pytest.raises(Exception, match="(?i)exists"):
        write_graph(g, os.path.join(out, "pq"))  # an existing folder is not replaced
    paths = write_graph(g, os.path.join(out, "csv"), fmt="csv")
    feat = spark.read.option("header", "true").csv(paths["actor_with_feature"])
    assert feat.count() == g["actor_with_feature"].count()
    assert feat.first()["languages"].startswith("[")


def test_release_removes_intermediates(spark):
    scores, act, cfg = fixture_inputs(spark, SF001)
    g = extract_graph(scores, act, cfg)
    paths = [m.path for m in g.intermediates]
    assert len(paths) == 7 and all(os.path.exists(p.replace("file:", "")) for p in paths)
    write_graph(g, os.path.join(tempfile.mkdtemp(prefix="cg-graph-"), "out"), release=True)
    assert not any(os.path.exists(p.replace("file:", "")) for p in paths)


def test_nested_topic_shapes_are_normalised(spark):
    nested = spark.createDataFrame(
        [(1, 2, 3, [("a",), ("b",)])],
        "event_id bigint, actor_id bigint, repo_id bigint, repo_topics array<struct<name:string>>")
    assert normalise_activity(nested).first()["repo_topics"] == ["a", "b"]
    dotted = spark.createDataFrame([(1, 2, 3, ["x"])], "event_id bigint, actor_id bigint, repo_id bigint, "
                                                        "`repo_topics.name` array<string>")
    row = normalise_activity(dotted).first()
    assert row["repo_topics"] == ["x"] and row["platform"] is None
    struct = spark.createDataFrame([(1, 2, 3, (["p", "q"],))], "event_id bigint, actor_id bigint, repo_id bigint, "
                                                              "repo_topics struct<name:array<string>>")
    assert normalise_activity(struct).first()["repo_topics"] == ["p", "q"]


def test_output_tables_never_rescan_the_activity_log(spark, graph):
    # both passes over the activity log happen inside extract_graph; every
    # output table reads only the materialised intermediates
    from cohortgraph.plans.checks import physical_plan
    _, _, _, g = graph
    for name, df in g.items():
        plan = physical_plan(df, "simple")
        assert "events.parquet" not in plan, name
        assert "lineitem.parquet" not in plan, name


def test_partitioned_activity_layout_prunes_and_matches(spark, tmp_path):
    from cohortgraph.operators import cohort as C_
    from cohortgraph.plans.checks import physical_plan
    from cohortgraph.sources.tables import read_activity, write_activity

    scores, act, cfg = fixture_inputs(spark, SF001)
    path = str(tmp_path / "activity")
    write_activity(act, path, num_partitions=4)
    stored = read_activity(spark, path)
    assert stored.count() == act.count()
    plan = physical_plan(C_.star_events(stored, cfg), "simple")
    assert "PartitionFilters: [isnotnull(platform" in plan and "(type#" in plan
    windowed = physical_plan(C_.star_events(stored, cfg, windowed=True), "simple")
    assert "event_year#" in windowed.split("PartitionFilters:")[1].split("PushedFilters")[0]
    years = C_.star_events(stored, cfg, windowed=True).select("event_year").distinct().collect()
    assert [r[0] for r in years] == [1998]
    cand = C_.candidates(scores, cfg)
    got = sorted(map(tuple, C_.sample_recent(stored, cand, cfg).collect()), key=repr)
    want = sorted(map(tuple, C_.sample_recent(act, cand, cfg).collect()), key=repr)
    assert got == want


def test_temp_views_show_the_inputs(spark):
    from cohortgraph.sources.tables import register_inputs

    scores, act, _ = fixture_inputs(spark, SF001)
    register_inputs(scores, act)
    per_type = spark.sql("SELECT type, count(*) AS n FROM activity GROUP BY type")
    assert _rows(per_type) == _rows(act.groupBy("type").count())
    assert spark.sql("SELECT count(*) FROM rank_scores").first()[0] == scores.count()


def test_pass_one_keeps_at_most_two_samples_per_repository(spark, graph):
    from cohortgraph.functions.joins import materialize
    from cohortgraph.plans.graph import pass_one_plan, samples

    scores, act, cfg, g = graph
    cand = materialize(C.candidates(scores, cfg))
    newest = pass_one_plan(act, cand, cfg)
    assert max(r["count"] for r in newest.groupBy("repo_id").count().collect()) <= 2 * cfg.sample_per_repo
    inside, all_time = samples(newest, cfg)
    assert _rows(inside) == _rows(C.sample_recent(act, cand, cfg, windowed=True))
    assert _rows(all_time) == _rows(C.sample_recent(act, cand, cfg))


def test_pass_two_is_written_in_narrow_slices(spark, graph):
    from cohortgraph.plans.graph import SLICE

    slices = next(m.df for m in graph[3].intermediates if SLICE in m.df.columns)
    payload = ["repo_language", "repo_topics", "repo_description"]
    edge, actor = (slices.where(F.col(SLICE) == s) for s in ("edge", "actor"))
    assert edge.where(" or ".join(f"{c} is not null" for c in payload)).count() == 0
    assert actor.where("repo_description is not null or issue_number is not null").count() == 0
    assert slices.where(F.col(SLICE) == "repo").where("issue_number is not null").count() == 0


def test_families_are_aggregated_once(graph):
    # edges without the repository and the membership read the written weights: nothing left to count
    from cohortgraph.plans.checks import physical_plan

    g = graph[3]
    for name in ("actor_contribute_pr", "actor_contribute_pr_belong_repo", "actor_discussion_issue"):
        assert "Aggregate" not in physical_plan(g[name], "simple"), name
    for name in ("pr_belong_repo", "issue_belong_repo"):
        assert "weight" not in physical_plan(g[name], "simple"), name


@pytest.mark.parametrize("limit", [1, 4_000_000])
def test_two_scans_of_the_log_whatever_the_node_sets(spark, graph, limit, monkeypatch):
    from cohortgraph.plans import graph as G
    from cohortgraph.plans.checks import physical_plan

    scores, act, cfg, _ = graph
    scans = []

    def counted(df, *a, **k):
        scans.append(physical_plan(df, "simple").count("events.parquet"))
        return materialize(df, *a, **k)

    materialize = G.materialize
    monkeypatch.setattr(G, "materialize", counted)
    extract_graph(scores, act, cfg.with_(broadcast_max_rows=limit)).release()
    assert sum(scans) == 2


def test_only_what_the_wanted_tables_need_is_computed(spark, graph):
    from cohortgraph.plans.graph import SLICE

    scores, act, cfg, full = graph
    g = extract_graph(scores, act, cfg, tables=["actor"])
    assert list(g) == ["actor"] and not any(SLICE in m.df.columns for m in g.intermediates)
    assert _rows(g["actor"]) == _rows(full["actor"])
    g.release()
    with pytest.raises(ValueError, match="unknown tables"):
        extract_graph(scores, act, cfg, tables=["nope"])


def test_intermediates_go_when_a_step_or_a_write_fails(spark, graph, monkeypatch, tmp_path):
    from cohortgraph.plans import graph as G

    scores, act, cfg, _ = graph
    kept, real = [], G.materialize

    def noted(df, *a, **k):
        if len(kept) == 4:
            raise RuntimeError("no more")
        kept.append(real(df, *a, **k))
        return kept[-1]

    monkeypatch.setattr(G, "materialize", noted)
    with pytest.raises(RuntimeError):
        extract_graph(scores, act, cfg)
    monkeypatch.undo()
    assert len(kept) == 4 and not any(os.path.exists(m.path.replace("file:", "")) for m in kept)
    g = extract_graph(scores, act, cfg, tables=["actor", "repo"])
    paths = [m.path for m in g.intermediates]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "actor").mkdir()
    with pytest.raises(Exception, match="(?i)exists"):
        write_graph(g, str(tmp_path / "out"), release=True)
    assert not any(os.path.exists(p.replace("file:", "")) for p in paths)


def test_command_line_job(spark, tmp_path):
    from cohortgraph.__main__ import main

    scores, act, cfg = fixture_inputs(spark, SF001)
    scores.write.parquet(str(tmp_path / "scores"))
    act.write.parquet(str(tmp_path / "activity"))
    out = str(tmp_path / "out")
    paths = main(["--scores", str(tmp_path / "scores"), "--activity", str(tmp_path / "activity"),
                  "--out", out, "--format", "csv", "--start-year", "1998", "--end-year", "1999",
                  "--top-n", str(cfg.top_n), "--sample", str(cfg.sample_per_repo),
                  "--pinned-org", "Brand#1", "--pinned-org", "Brand#2", "--pinned-name", "Brand#3/cold rod",
                  "--tables", "actor,actor_contribute_pr,actor_with_feature"], spark=spark)
    assert sorted(paths) == ["actor", "actor_contribute_pr", "actor_with_feature"]
    read, g = spark.read.option("header", "true").csv, extract_graph(scores, act, cfg)
    for name in paths:
        assert read(paths[name]).count() == g[name].count() > 0
    with pytest.raises(SystemExit):  # before any job
        main(["--scores", "none", "--activity", "none", "--out", out, "--tables", "actor,nope"], spark=spark)


def test_partitioned_scores_layout(spark, tmp_path):
    from cohortgraph.operators import cohort as C_
    from cohortgraph.plans.checks import physical_plan
    from cohortgraph.sources.tables import read_scores, write_scores

    scores, act, cfg = fixture_inputs(spark, SF001)
    path = str(tmp_path / "scores")
    write_scores(scores, path, num_partitions=4)
    stored = read_scores(spark, path)
    plan = physical_plan(C_.top_entities(stored, cfg), "simple")
    assert "PartitionFilters: [isnotnull(platform" in plan
    assert sorted(map(tuple, C_.candidates(stored, cfg).collect())) == \
        sorted(map(tuple, C_.candidates(scores, cfg).collect()))


def test_empty_window_gives_empty_tables(spark, tmp_path):
    scores, act, cfg = fixture_inputs(spark, SF001)
    empty_cfg = cfg.with_(start=cfg.start.replace(year=1980), end=cfg.end.replace(year=1981), pinned_orgs=(),
                          pinned_names=())
    g = extract_graph(scores, act, empty_cfg)
    assert g.intermediates[0].rows == 0  # no candidates
    paths = write_graph(g, str(tmp_path / "out"), release=True)
    assert all(spark.read.parquet(p).count() == 0 for p in paths.values())


def test_loose_bounds_are_tightened_to_keep_broadcasts(spark):
    # the sampled rows exceed the limit but the distinct actors do not: the
    # actor set is counted exactly and still broadcast
    from tests.conftest import SF01

    scores, act, cfg = fixture_inputs(spark, SF01)
    co = build_cohort(scores, act, cfg)
    actors = C.actor_set(co.sample).count()
    assert actors < co.sample.rows
    tight = build_cohort(scores, act, cfg.with_(broadcast_max_rows=actors), cand=co.candidates)
    assert tight.actors.path is not None and tight.actors.rows == actors


def test_csv_inputs_round_trip(spark, tmp_path):
    # the graph's own CSV form (arrays as JSON text) reads back as the same activity
    from cohortgraph.plans.graph import _csv_ready
    from cohortgraph.sources.tables import read_activity

    _, act, _ = fixture_inputs(spark, SF001)
    path = str(tmp_path / "act_csv")
    _csv_ready(act).write.option("header", "true").csv(path)
    back = read_activity(spark, path, "csv", header="true", inferSchema="true")
    assert dict(back.dtypes)["repo_topics"] == "array<string>"
    assert sorted(map(tuple, back.select("event_id", "repo_topics").collect())) == \
        sorted(map(tuple, act.select("event_id", "repo_topics").collect()))


def test_command_line_job_on_csv_inputs(spark, tmp_path):
    from cohortgraph.__main__ import main
    from cohortgraph.plans.graph import _csv_ready

    scores, act, cfg = fixture_inputs(spark, SF001)
    _csv_ready(scores).write.option("header", "true").csv(str(tmp_path / "scores"))
    _csv_ready(act).write.option("header", "true").csv(str(tmp_path / "activity"))
    paths = main(["--scores", str(tmp_path / "scores"), "--activity", str(tmp_path / "activity"),
                  "--scores-format", "csv", "--activity-format", "csv",
                  "--reader-option", "header=true", "--reader-option", "inferSchema=true",
                  "--out", str(tmp_path / "out"), "--start-year", "1998", "--end-year", "1999",
                  "--top-n", str(cfg.top_n), "--sample", str(cfg.sample_per_repo),
                  "--pinned-org", "Brand#1", "--pinned-org", "Brand#2", "--pinned-name", "Brand#3/cold rod",
                  "--tables", "actor_contribute_pr_belong_repo,actor_with_feature"], spark=spark)
    got = spark.read.parquet(paths["actor_contribute_pr_belong_repo"])
    want = extract_graph(scores, act, cfg)["actor_contribute_pr_belong_repo"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(paths["actor_with_feature"]).count() > 0
