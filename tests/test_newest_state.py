"""The stored newest-K state: built in steps it equals one pass over the whole log, and reads new files only."""

from __future__ import annotations

import random

import pytest

from cohortgraph import ExtractConfig
from cohortgraph.functions import commits
from cohortgraph.operators import cohort as C
from cohortgraph.plans.newest_state import StarState
from cohortgraph.sources import read_activity, write_activity
from tests.conftest import ACTIVITY_SCHEMA, Acts, ts

CFG = ExtractConfig.for_years(2021, 2023, sample_per_repo=4)
COLUMNS = ["actor_id", "repo_id", "created_at", "event_id", "rn"]


def deliveries(spark):
    """Three deliveries: one hot repository, late events, repeated events, odd rows."""
    rng, parts = random.Random(11), []
    sent = []
    for k in range(3):
        acts = Acts()
        for n in range(300):
            repo = 1 if n % 3 == 0 else rng.randrange(2, 40)
            when = ts(rng.choice([2020, 2021, 2022, 2023]), rng.randrange(1, 13), rng.randrange(1, 3))
            acts.add(rng.randrange(50), repo, when, event_id=k * 1000 + n,
                     type="WatchEvent" if n % 5 else "ForkEvent", platform="Gitee" if n % 11 == 0 else "GitHub")
        acts.rows += rng.sample(sent, min(len(sent), 60))  # delivered once more
        acts.rows.append((k * 1000 + 900, 3, 5, "r5", None, "GitHub", "WatchEvent", None, "", [], ""))
        acts.rows.append((k * 1000 + 901, 3, None, None, ts(2022), "GitHub", "WatchEvent", None, "", [], ""))
        sent += acts.rows
        parts.append(acts.df(spark))
    return parts


@pytest.fixture()
def cand(spark):
    return spark.createDataFrame([(r,) for r in range(0, 40, 2)] + [(1,), (5,)], "repo_id bigint")


def rows(df):
    return sorted(map(repr, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("distinct", [False, True])
def test_three_steps_equal_one_pass(spark, cand, tmp_path, distinct):
    log, parts = str(tmp_path / "log"), deliveries(spark)
    state = StarState(spark, str(tmp_path / "state"), CFG, distinct_events=distinct)
    assert state.version() == 0 and state.sample(cand).count() == 0
    for k, part in enumerate(parts):
        write_activity(part, log, num_partitions=2, mode="append")
        assert state.ingest(log) > 0
        whole = read_activity(spark, log)
        whole = whole.distinct() if distinct else whole
        for windowed in (False, True):
            assert rows(state.sample(cand, windowed)) == rows(C.sample_recent(whole, cand, CFG, windowed))
        assert state.version() == k + 1
    assert state.ingest(log) == 0 and state.version() == 3  # nothing is taken twice
    before = rows(state.sample(cand))
    state.drop_old_versions()
    assert rows(state.sample(cand)) == before


def test_a_step_reads_only_new_files_and_rewrites_only_their_years(spark, cand, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    write_activity(Acts().add(1, 2, ts(2020)).add(2, 2, ts(2021)).df(spark), log, num_partitions=1)
    state = StarState(spark, str(tmp_path / "state"), CFG)
    state.ingest(log)
    years = commits.latest(spark, state.path)[1]["years"]
    write_activity(Acts().add(3, 2, ts(2021, 5), event_id=9).df(spark), log, num_partitions=1, mode="append")
    fresh = {r.path for r in state.new_files(log).collect()}
    assert len(fresh) == 1
    read = []
    monkeypatch.setattr(StarState, "_newest_of", lambda self, act, of=StarState._newest_of:
                        (read.extend(act.inputFiles()), of(self, act))[1])
    assert state.ingest(log) == 1
    assert {f.split("://")[-1].lstrip("/") for f in read} == {f.split(":", 1)[-1].lstrip("/") for f in fresh}
    after = commits.latest(spark, state.path)[1]["years"]
    assert after["2020"] == years["2020"] and after["2021"] != years["2021"]


def test_a_failed_step_leaves_the_former_version(spark, cand, tmp_path, monkeypatch):
    log, parts = str(tmp_path / "log"), deliveries(spark)
    state = StarState(spark, str(tmp_path / "state"), CFG)
    write_activity(parts[0], log, num_partitions=1)
    state.ingest(log)
    before = rows(state.sample(cand))
    write_activity(parts[1], log, num_partitions=1, mode="append")
    with monkeypatch.context() as m:
        m.setattr(commits, "put_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.ingest(log)
    assert state.version() == 1 and rows(state.sample(cand)) == before
    state.ingest(log)
    assert rows(state.sample(cand)) == rows(C.sample_recent(read_activity(spark, log), cand, CFG))


def test_errors(spark, cand, tmp_path):
    log = str(tmp_path / "log")
    write_activity(Acts().add(1, 2, ts(2021)).df(spark), log, num_partitions=1)
    state = StarState(spark, str(tmp_path / "state"), CFG)
    state.ingest(log)
    with pytest.raises(FileExistsError):  # of two writers on the same version, one fails
        commits.commit(spark, state.path, 1, {})
    with pytest.raises(ValueError, match="was made with"):
        StarState(spark, state.path, CFG.with_(sample_per_repo=9)).sample(cand)
    with pytest.raises(ValueError, match="whole years"):
        StarState(spark, state.path, CFG.with_(end=ts(2022, 6))).sample(cand, windowed=True)
    path = state.ledger().first().path.split(":", 1)[-1]
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="was changed"):
        state.ingest(log)


def test_empty_log(spark, cand, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([], ACTIVITY_SCHEMA).write.parquet(log)
    state = StarState(spark, str(tmp_path / "state"), CFG)
    state.ingest(log)
    assert state.sample(cand).count() == 0 and state.sample(cand, windowed=True).count() == 0


def test_many_ledgers_become_one(spark, cand, tmp_path, monkeypatch):
    monkeypatch.setattr("cohortgraph.plans.newest_state.MAX_LEDGERS", 2)
    log = str(tmp_path / "log")
    state = StarState(spark, str(tmp_path / "state"), CFG)
    for k in range(3):
        write_activity(Acts().add(k, 2, ts(2021, 1 + k), event_id=k).df(spark), log, num_partitions=1, mode="append")
        state.ingest(log)
    assert len(commits.latest(spark, state.path)[1]["ledgers"]) == 1
    assert state.ledger().count() == 3 and state.ingest(log) == 0
