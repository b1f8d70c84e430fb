"""Runs that go on where they stopped, and graphs that readers see whole or not at all."""

from __future__ import annotations

import os

import pytest

from cohortgraph import extract_graph, publish_graph, read_graph
from cohortgraph.__main__ import main
from cohortgraph.functions import commits
from cohortgraph.plans import graph as G
from cohortgraph.plans import resume
from cohortgraph.plans.checks import physical_plan
from cohortgraph.sources import read_activity, read_scores, write_activity, write_scores
from cohortgraph.sources.fixtures import fixture_inputs
from tests.conftest import SF001, Acts, ts

TABLES = ["actor", "actor_fork_repo", "pr_belong_repo", "actor_contribute_pr", "repo_with_feature"]


def rows(tables):
    return {name: sorted(map(repr, df.collect())) for name, df in tables.items()}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("inputs")
    scores, act, cfg = fixture_inputs(spark, SF001)
    write_activity(act, str(folder / "activity"), num_partitions=2)
    write_scores(scores, str(folder / "scores"), num_partitions=2)
    return read_scores(spark, str(folder / "scores")), read_activity(spark, str(folder / "activity")), cfg, folder


@pytest.fixture(scope="module")
def expected(spark, inputs):
    scores, act, cfg, _ = inputs
    graph = extract_graph(scores, act, cfg, tables=TABLES)
    want = rows(graph)
    graph.release()
    return want


def scans(monkeypatch, module=resume):
    """The names of the steps that are written, with their scans of the log."""
    seen = []

    def noted(df, partition_by=None, path=None, of=module.materialize):
        seen.append((os.path.basename(path).split("-")[0], physical_plan(df, "simple").count("/activity")))
        return of(df, partition_by, path)

    monkeypatch.setattr(module, "materialize", noted)
    return seen


def test_a_run_goes_on_behind_pass_one(spark, inputs, expected, tmp_path, monkeypatch):
    scores, act, cfg, _ = inputs
    seen = scans(monkeypatch)
    with monkeypatch.context() as m:
        m.setattr(G, "node_events_plan", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # stopped between the passes
            extract_graph(scores, act, cfg, tables=TABLES, run_dir=str(tmp_path))
    first = [name for name, _ in seen]
    assert "newest" in first and "node_events" not in first
    graph = extract_graph(scores, act, cfg, tables=TABLES, run_dir=str(tmp_path))
    names = [name for name, _ in seen]
    assert len(names) == len(set(names))  # no step was computed twice
    assert [name for name, n in seen if n] == ["newest", "node_events"] and sum(n for _, n in seen) == 2
    assert rows(graph) == expected
    again = extract_graph(scores, act, cfg, tables=TABLES, run_dir=str(tmp_path))
    assert len(seen) == len(names) and rows(again) == expected
    graph.release()
    assert not os.listdir(tmp_path)
    assert rows(extract_graph(scores, act, cfg, tables=TABLES, run_dir=str(tmp_path))) == expected


def test_a_half_written_step_is_not_trusted(spark, inputs, expected, tmp_path, monkeypatch):
    scores, act, cfg, _ = inputs
    with monkeypatch.context() as m:  # lost after the write, before the record
        m.setattr(commits, "put_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            extract_graph(scores, act, cfg, tables=TABLES, run_dir=str(tmp_path))
    assert rows(extract_graph(scores, act, cfg, tables=TABLES, run_dir=str(tmp_path))) == expected


def test_other_inputs_or_parameters_are_another_run(spark, inputs, tmp_path):
    scores, _, cfg, _ = inputs
    log = str(tmp_path / "log")
    write_activity(Acts().add(1, 2, ts(2022)).df(spark), log, num_partitions=1)

    def key(*parameters):
        return resume.fingerprint(spark, {"scores": scores, "activity": read_activity(spark, log)}, parameters)

    one = key(cfg, False)
    assert one == key(cfg, False)
    assert one not in (key(cfg, True), key(cfg.with_(sample_per_repo=6), False))
    write_activity(Acts().add(2, 2, ts(2022)).df(spark), log, num_partitions=1, mode="append")
    assert one != key(cfg, False)
    with pytest.raises(ValueError, match="without files"):
        resume.fingerprint(spark, {"activity": Acts().add(1, 2, ts(2022)).df(spark)}, [])
    assert resume.fingerprint(spark, {"a": scores}, [], "snapshot 7") != resume.fingerprint(spark, {"a": scores}, [], "8")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_readers_see_the_former_graph_until_the_commit(spark, inputs, expected, tmp_path, monkeypatch, fmt):
    scores, act, cfg, _ = inputs
    out = str(tmp_path / "out")
    assert read_graph(spark, out) == {}
    graph = extract_graph(scores, act, cfg, tables=TABLES)
    assert publish_graph(graph, out, fmt) == 1
    seen = {t: df.count() for t, df in read_graph(spark, out).items()}
    assert seen == {t: len(r) for t, r in expected.items()}
    if fmt == "parquet":
        assert rows(read_graph(spark, out)) == expected
    small = extract_graph(scores, act, cfg.with_(sample_per_repo=1), tables=TABLES)
    with monkeypatch.context() as m:
        m.setattr(commits, "put_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            publish_graph(small, out, fmt)
    assert {t: df.count() for t, df in read_graph(spark, out).items()} == seen
    assert len(os.listdir(f"{out}/graphs")) == 1
    assert publish_graph(small, out, fmt, release=True) == 2
    assert read_graph(spark, out)["actor"].count() < seen["actor"]
    graph.release()


def test_command_line(spark, inputs, expected, tmp_path):
    folder = inputs[3]
    main(["--scores", str(folder / "scores"), "--activity", str(folder / "activity"), "--out", str(tmp_path / "out"),
          "--tables", "actor,repo", "--run-dir", str(tmp_path / "runs"), "--publish", "--start-year", "1998",
          "--end-year", "1999", "--pinned-org", "Brand#1"], spark)
    assert set(read_graph(spark, str(tmp_path / "out"))) == {"actor", "repo"}
    assert not os.listdir(tmp_path / "runs")
