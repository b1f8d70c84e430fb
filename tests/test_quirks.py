"""One hand-made micro table per behaviour decision."""

from __future__ import annotations

from datetime import timedelta

from cohortgraph.config import ExtractConfig
from cohortgraph.operators import cohort as C
from cohortgraph.operators import edges as E
from cohortgraph.operators import explore as X
from cohortgraph.operators import features as FT
from cohortgraph.plans.graph import build_cohort
from tests.conftest import Acts, scores_df, ts

US = timedelta(microseconds=1)


def cfg(**kw):
    base = dict(top_n=10, pinned_orgs=("pin-org",), pinned_names=("pin/name",), sample_per_repo=2)
    base.update(kw)
    return ExtractConfig.for_years(2022, 2023, **base)


def ids(df, col="repo_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_year_window_edges(spark):
    # D1: the window is [2022-01-01, 2023-01-01) at microsecond precision
    s = scores_df(spark, [
        (1, "a/x", "a", 1000, ts(2022) - US),
        (1, "a/x", "a", 10, ts(2022)),
        (1, "a/x", "a", 20, ts(2023) - US),
        (1, "a/x", "a", 1000, ts(2023)),
    ])
    row = C.top_entities(s, cfg()).first()
    assert row["avg_score"] == 15.0


def test_window_applies_to_star_sample_only_when_asked(spark):
    # D2: an actor whose only star is outside the window is a node of the
    # all-time sample but has no windowed star edge
    s = scores_df(spark, [(1, "a/x", "a", 5, ts(2022, 6))])
    a = Acts().add(10, 1, ts(2022, 3)).add(11, 1, ts(2021, 3)).df(spark)
    c = cfg(sample_per_repo=5)
    all_time = build_cohort(s, a, c)
    windowed = build_cohort(s, a, c, windowed=True)
    assert ids(C.actor_nodes(all_time.sample), "actor_id") == [10, 11]
    assert sorted(tuple(r) for r in E.star_edges(windowed.sample).collect()) == [(10, 1)]


def test_renamed_repo_takes_two_slots(spark):
    # D3: grouping by (id, name) lets one renamed repository fill two of N slots
    s = scores_df(spark, [
        (1, "a/x-old", "a", 100, ts(2022, 2)),
        (1, "a/x", "a", 90, ts(2022, 9)),
        (2, "b/y", "b", 50, ts(2022, 5)),
    ])
    c = cfg(top_n=2)
    assert [tuple(r) for r in C.top_entities(s, c).select("repo_id", "repo_name").collect()] == \
        [(1, "a/x-old"), (1, "a/x")]
    assert ids(C.candidates(s, c)) == [1]


def test_equal_timestamps_break_on_event_id(spark):
    # D4: K+1 stars at one instant; the newest event ids win
    s = scores_df(spark, [(1, "a/x", "a", 5, ts(2022, 6))])
    acts = Acts()
    for actor, eid in [(1, 10), (2, 11), (3, 12)]:
        acts.add(actor, 1, ts(2022, 5), event_id=eid)
    co = build_cohort(s, acts.df(spark), cfg(sample_per_repo=2))
    got = sorted((r["event_id"], r["rn"]) for r in co.sample.df.collect())
    assert got == [(11, 2), (12, 1)]


def test_equal_averages_at_the_cut(spark):
    # D5: two repositories share the average at the cut; the smaller id wins
    s = scores_df(spark, [(2, "b/y", "b", 50, ts(2022, 5)), (1, "a/x", "a", 50, ts(2022, 5)),
                          (3, "c/z", "c", 10, ts(2022, 5))])
    assert ids(C.top_entities(s, cfg(top_n=1))) == [1]


def test_repeated_star_uses_two_places(spark):
    # D6: the cap counts events, not actors
    s = scores_df(spark, [(1, "a/x", "a", 5, ts(2022, 6))])
    a = (Acts().add(7, 1, ts(2022, 5)).add(7, 1, ts(2022, 4)).add(8, 1, ts(2022, 3)).df(spark))
    co = build_cohort(s, a, cfg(sample_per_repo=2))
    assert co.sample.rows == 2
    assert ids(C.actor_nodes(co.sample), "actor_id") == [7]
    counts = C.cohort_counts(co.sample).first()
    assert (counts["actor_count"], counts["repo_count"]) == (1, 1)


def test_entity_type_filter(spark):
    # D7: a non-Repo score row with a NULL id is a candidate unless entity_type is set
    s = scores_df(spark, [(None, "u", "u", 1e9, ts(2022, 5), "GitHub", "User"),
                          (1, "a/x", "a", 5, ts(2022, 5))])
    assert C.candidates(s, cfg()).count() == 2
    assert ids(C.candidates(s, cfg(entity_type="Repo"))) == [1]


def _two_node_cohort(spark, extra):
    s = scores_df(spark, [(1, "a/x", "a", 5, ts(2022, 6))])
    acts = Acts().add(7, 1, ts(2022, 5))
    extra(acts)
    a = acts.df(spark)
    return a, build_cohort(s, a, cfg(sample_per_repo=5))


def test_null_issue_number_gives_null_key(spark):
    # D8: concat with a NULL number yields a NULL key; such events group together
    a, co = _two_node_cohort(spark, lambda x: x.add(7, 1, ts(2022, 6), "PullRequestEvent", issue=None)
                             .add(7, 1, ts(2022, 7), "PullRequestReviewEvent", issue=None)
                             .add(7, 1, ts(2022, 7), "PullRequestEvent", issue=4))
    c = cfg(sample_per_repo=5)
    got = sorted(((r["pr_id"] or ""), r["weight"]) for r in E.pr_edges(a, co.actors, co.repos, c).collect())
    assert got == [("", 2), ("1#4", 1)]
    dropped = E.pr_edges(a, co.actors, co.repos, c.with_(drop_null_items=True)).collect()
    assert [(r["pr_id"], r["weight"]) for r in dropped] == [("1#4", 1)]


def test_feature_gaps_drop_actors_from_inner_join(spark):
    # D9: language-only and topic-only actors vanish; blank/NULL language and
    # empty/NULL topics never count
    def extra(x):
        for actor in (7, 8, 9):
            x.add(actor, 1, ts(2022, 5))  # stars make all three nodes
        x.add(7, 1, ts(2021, 1), "PullRequestEvent", lang="Go", topics=["db"])
        x.add(8, 1, ts(2021, 1), "PullRequestEvent", lang="Rust", topics=[])
        x.add(8, 1, ts(2021, 1), "PullRequestEvent", lang="", topics=None)
        x.add(9, 1, ts(2021, 1), "PullRequestEvent", lang=None, topics=["web"])
        x.add(9, 1, ts(2021, 1), "PullRequestEvent", lang="", topics=["ui"])
    a, co = _two_node_cohort(spark, extra)
    c = cfg(sample_per_repo=5)
    ev = FT.actor_feature_events(a, co.actors, c)
    inner = {r["actor_id"]: (r["languages"], r["topics"]) for r in FT.actor_features(ev, c).collect()}
    assert inner == {7: (["Go"], ["db"])}
    outer = {r["actor_id"]: (r["languages"], r["topics"]) for r in FT.actor_features(ev, c, "outer").collect()}
    assert outer == {7: (["Go"], ["db"]), 8: (["Rust"], None), 9: (None, ["ui", "web"])}


def test_repo_features_ignore_the_window(spark):
    # D10: the newest PR-family event may lie after the window end
    a, co = _two_node_cohort(spark, lambda x: x.add(7, 1, ts(2022, 5), "PullRequestEvent", lang="Go")
                             .add(7, 1, ts(2024, 5), "PullRequestReviewEvent", lang="Zig", desc="new"))
    row = FT.repo_features(a, co.repos, cfg()).first()
    assert (row["repo_language"], row["repo_description"]) == ("Zig", "new")
    # the optional window keeps the newest event inside the window instead
    assert FT.repo_features(a, co.repos, cfg(), window=True).first()["repo_language"] == "Go"
    # non_blank_only filters before the ranking
    a2, co2 = _two_node_cohort(spark, lambda x: x.add(7, 1, ts(2022, 5), "PullRequestEvent", lang="Go")
                               .add(7, 1, ts(2024, 5), "PullRequestEvent", lang=""))
    assert FT.repo_features(a2, co2.repos, cfg()).first()["repo_language"] == ""
    assert FT.repo_features(a2, co2.repos, cfg(), non_blank_only=True).first()["repo_language"] == "Go"
    cnt = FT.repo_feature_count(a2, co2.repos, cfg()).first()
    assert (cnt["repos_with_features"], cnt["repos_with_topic_or_language"]) == (1, 1)


def test_repo_features_of_repeated_and_missing_event_ids(spark):
    def extra(x):
        for _ in range(2):  # delivered twice
            x.add(7, 1, ts(2022, 5), "PullRequestEvent", lang="Go", topics=["db"], desc="one", event_id=900)
        x.add(7, 2, ts(2022, 4), "PullRequestEvent", lang="Go")
        x.add(7, 2, ts(2022, 5), "PullRequestEvent", lang="Zig", desc="two", event_id=901)
        x.rows[-1] = (None, *x.rows[-1][1:])
    a, _ = _two_node_cohort(spark, extra)
    repos = spark.createDataFrame([(1,), (2,)], "repo_id bigint")
    for non_blank_only in (False, True):
        got = FT.repo_features(a, repos, cfg(), non_blank_only=non_blank_only).orderBy("repo_id").collect()
        assert [tuple(r) for r in got] == [(1, "Go", ["db"], "one"), (2, "Zig", [], "two")]


def test_language_ties_and_feature_types(spark):
    # D11/D12: four languages with equal counts keep the three first by name;
    # a review event's language does not count (PullRequestEvent only)
    def extra(x):
        for lang in ("D", "B", "A", "C"):
            x.add(7, 1, ts(2021, 1), "PullRequestEvent", lang=lang, topics=["t"])
        x.add(7, 1, ts(2021, 1), "PullRequestReviewEvent", lang="AAA", topics=["zzz"])
        x.add(7, 1, ts(2021, 1), "PullRequestReviewEvent", lang="AAA")
    a, co = _two_node_cohort(spark, extra)
    c = cfg()
    ev = FT.actor_feature_events(a, co.actors, c)
    ranks = [(r["repo_language"], r["language_rank"]) for r in
             FT.actor_language_ranks(ev, c).orderBy("language_rank").collect()]
    assert ranks == [("A", 1), ("B", 2), ("C", 3)]
    row = FT.actor_features(ev, c).first()
    assert row["languages"] == ["A", "B", "C"] and row["topics"] == ["t"]
    assert FT.actor_features(ev, c.with_(top_languages=1)).first()["languages"] == ["A"]


def test_pinned_and_ranked(spark):
    # a repository in both branches appears once; a pinned repository without
    # stars is a candidate but not a repository node
    s = scores_df(spark, [(1, "pin/name", "x", 100, ts(2022, 5)), (2, "b/y", "pin-org", 1, ts(2022, 5)),
                          (3, "c/z", "c", 50, ts(2022, 5))])
    a = Acts().add(7, 1, ts(2022, 5)).add(8, 3, ts(2022, 5)).df(spark)
    c = cfg(top_n=2)
    assert ids(C.candidates(s, c)) == [1, 2, 3]
    assert ids(C.pinned_entities(s, c)) == [1, 2]
    co = build_cohort(s, a, c)
    assert ids(C.repo_nodes(co.sample)) == [1, 3]


def test_offset_past_the_end_leaves_pinned(spark):
    s = scores_df(spark, [(1, "a/x", "a", 100, ts(2022, 5)), (2, "b/y", "pin-org", 1, ts(2022, 5))])
    c = cfg(top_n=10, offset=5)
    assert C.top_entities(s, c).count() == 0
    assert ids(C.candidates(s, c)) == [2]
    assert ids(C.top_entities(s, cfg(top_n=1, offset=1))) == [2]


def test_platform_filter(spark):
    s = scores_df(spark, [(1, "a/x", "a", 100, ts(2022, 5), "Gitee"), (2, "b/y", "b", 1, ts(2022, 5))])
    assert ids(C.candidates(s, cfg())) == [2]
    a = Acts().add(7, 2, ts(2022, 5), platform="Gitee").add(8, 2, ts(2022, 5)).df(spark)
    assert ids(C.actor_nodes(build_cohort(s, a, cfg()).sample), "actor_id") == [8]


def test_fork_edges_any_node_pair(spark):
    # a fork between any sampled actor and any sampled repo counts, even if
    # that actor did not star that repository; forks outside the window do not
    s = scores_df(spark, [(1, "a/x", "a", 5, ts(2022, 6)), (2, "b/y", "b", 4, ts(2022, 6))])
    a = (Acts().add(7, 1, ts(2022, 5)).add(8, 2, ts(2022, 5))
         .add(7, 2, ts(2022, 6), "ForkEvent").add(7, 2, ts(2022, 7), "ForkEvent")
         .add(8, 1, ts(2023, 6), "ForkEvent").add(9, 1, ts(2022, 6), "ForkEvent").df(spark))
    co = build_cohort(s, a, cfg(), windowed=True)
    assert sorted(tuple(r) for r in E.fork_edges(a, co.actors, co.repos, cfg()).collect()) == [(7, 2)]


def test_explore_queries(spark):
    a = (Acts().add(7, 1, ts(2022, 5), "PullRequestEvent", lang="Go", topics=["x"], name="o/p")
         .add(7, 1, ts(2022, 6), "IssuesEvent", lang="C", topics=["y", "z"], name="o/p")
         .add(8, 2, ts(2022, 7), "PullRequestReviewEvent", lang="Py", name="q/r").df(spark))
    c = cfg()
    prof = X.latest_repo_profile(a, "o/p", c).collect()
    assert [(r["repo_language"], r["repo_topics"]) for r in prof] == [("C", ["y", "z"])]
    hist = FT.actor_history(a, 7, c)
    assert [r["repo_language"] for r in hist.collect()] == ["Go"]
    assert sorted(r[0] for r in X.types_with_topics(a, c).collect()) == ["IssuesEvent", "PullRequestEvent"]
    s = scores_df(spark, [(i, f"n{i}", "o", i, ts(2022, 1, 1 + i), "GitHub", "Repo" if i % 2 else "User")
                          for i in range(1, 12)])
    assert ids(X.latest_scores(s, "Repo", 3)) == [7, 9, 11]
    prof_rows = {r["col_name"]: r["data_type"] for r in X.table_profile(a).collect()}
    assert prof_rows["repo_topics"] == "array<string>" and prof_rows["created_at"] == "timestamp_ntz"


def test_stars_per_actor_counts_all_windowed_stars(spark):
    s = scores_df(spark, [(1, "a/x", "a", 5, ts(2022, 6)), (2, "b/y", "b", 4, ts(2022, 6))])
    a = (Acts().add(7, 1, ts(2022, 5)).add(7, 1, ts(2022, 6)).add(7, 2, ts(2022, 5))
         .add(8, 2, ts(2021, 5)).df(spark))
    got = {r["actor_id"]: r["starred_repos"] for r in E.stars_per_actor(a, C.candidates(s, cfg()), cfg()).collect()}
    assert got == {7: 2}
    got_all = {r["actor_id"]: r["starred_repos"]
               for r in E.stars_per_actor(a, C.candidates(s, cfg()), cfg(), windowed=False).collect()}
    assert got_all == {7: 2, 8: 1}
