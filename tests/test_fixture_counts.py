"""The fixture mapping: row counts, growth with the data, and a sample cap that cuts at every scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortgraph.operators import cohort as C
from cohortgraph.sources.fixtures import HOT_REPOS, fixture_config, fixture_inputs

SF = {s: f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1")}


@pytest.mark.parametrize("sf,events,scores_", [("0.001", 1_000, 6_000), ("0.01", 10_000, 60_000)])
def test_inputs_keep_every_row(spark, sf, events, scores_):
    scores, act, cfg = fixture_inputs(spark, SF[sf])
    assert act.count() == events and scores.count() == scores_
    assert cfg == fixture_config()


@pytest.mark.parametrize("sf", list(SF))
def test_the_cap_cuts_at_every_scale(spark, sf):
    scores, act, cfg = fixture_inputs(spark, SF[sf])
    stars = C.candidate_stars(act, C.candidates(scores, cfg), cfg)
    most = stars.groupBy("repo_id").count().agg(F.max("count")).first()[0]
    assert most > cfg.sample_per_repo
    sample = C.newest_per_repo(stars, cfg)
    assert sample.groupBy("repo_id").count().agg(F.max("count")).first()[0] == cfg.sample_per_repo


def test_repositories_and_candidates_grow_with_the_data(spark):
    seen = []
    for sf in SF:
        scores, act, cfg = fixture_inputs(spark, SF[sf])
        hot = act.where(F.col("repo_id") < HOT_REPOS).count() / act.count()
        seen.append((act.select("repo_id").distinct().count(), C.candidates(scores, cfg).count()))
        assert hot > 0.3
    assert seen[0][0] < seen[1][0] < seen[2][0] and seen[0][1] < seen[1][1] < seen[2][1], seen
