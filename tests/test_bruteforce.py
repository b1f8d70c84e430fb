"""Operators against a plain-pandas implementation on random micro-tables.

Random data with many ties (few distinct timestamps), NULL issue numbers,
blank/NULL languages, empty/NULL topic arrays, a renamed repository, pinned
rows and another platform; two cases put a third of all events on one
repository, one of them with both two-round paths (top-k and top-N) forced.
The pandas code below is a direct, row-by-row reading of the semantics; the
Spark operators must agree with it exactly.
"""

from __future__ import annotations

import random

import pandas as pd
import pytest

from cohortgraph.config import ExtractConfig
from cohortgraph.operators import cohort as C
from cohortgraph.operators import edges as E
from cohortgraph.operators import features as FT
from cohortgraph.plans.graph import build_cohort, extract_graph
from tests.conftest import ACTIVITY_SCHEMA, SCORE_SCHEMA, ts

TYPES = ["WatchEvent"] * 6 + ["ForkEvent", "PushEvent", "PullRequestEvent", "PullRequestEvent",
                              "PullRequestReviewEvent", "PullRequestReviewCommentEvent", "IssuesEvent",
                              "IssuesReactionEvent", "IssueCommentEvent"]
LANGS = ["", None, "Go", "C", "Py", "Rs"]
TOPICS = [[], None, ["db"], ["db", "web"], ["ml", None], ["web", "ui", "db"]]
WHEN = [ts(2021, 12, 31), ts(2022, 3, 1), ts(2022, 3, 1), ts(2022, 7, 9), ts(2022, 12, 31, 23, 59, 59),
        ts(2023, 1, 1), ts(2023, 5, 2)]


def make_data(seed, n_events=500, hot_share=0.0):
    rnd = random.Random(seed)
    acts = []
    for eid in range(1, n_events + 1):
        repo = 1 if rnd.random() < hot_share else rnd.randint(1, 9)
        acts.append((eid, rnd.randint(1, 15), repo, "r", rnd.choice(WHEN),
                     "Gitee" if rnd.random() < 0.1 else "GitHub", rnd.choice(TYPES),
                     rnd.choice([None, 1, 2, 3]), rnd.choice(LANGS), rnd.choice(TOPICS), f"d{eid % 4}"))
    scores = []
    for i in range(120):
        repo = rnd.randint(1, 10)
        name = f"o{repo % 3}/n{repo}" + ("-old" if repo == 2 and rnd.random() < 0.5 else "")
        scores.append((repo, name, f"org{repo % 4}", "Gitee" if rnd.random() < 0.1 else "GitHub",
                       "Repo" if rnd.random() < 0.8 else "User", float(rnd.randint(1, 20)), rnd.choice(WHEN)))
    return acts, scores


def frames(spark, acts, scores):
    a_cols = [c.split()[0] for c in ACTIVITY_SCHEMA.split(", ")]
    s_cols = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]
    return (spark.createDataFrame(acts, ACTIVITY_SCHEMA), spark.createDataFrame(scores, SCORE_SCHEMA),
            pd.DataFrame(acts, columns=a_cols), pd.DataFrame(scores, columns=s_cols))


# ---------------------------------------------------------------- pandas side

def in_win(df, cfg):
    return (df.created_at >= cfg.start) & (df.created_at < cfg.end)


def ref_candidates(sc, cfg):
    w = sc[(sc.platform == cfg.platform) & in_win(sc, cfg)]
    if cfg.entity_type:
        w = w[w.type == cfg.entity_type]
    avg = w.groupby(["repo_id", "repo_name"]).openrank.mean().reset_index()
    ranked = avg.sort_values(["openrank", "repo_id", "repo_name"], ascending=[False, True, True])
    ranked = ranked.iloc[cfg.offset:cfg.offset + cfg.top_n]
    pinned = w[w.org_login.isin(cfg.pinned_orgs) | w.repo_name.isin(cfg.pinned_names)]
    return set(ranked.repo_id) | set(pinned.repo_id)


def ref_sample(act, cand, cfg, windowed):
    st = act[(act.platform == cfg.platform) & (act.type == "WatchEvent") & act.repo_id.isin(cand)]
    if windowed:
        st = st[in_win(st, cfg)]
    st = st.sort_values(["repo_id", "created_at", "event_id"], ascending=[True, False, False]).copy()
    st["rn"] = st.groupby("repo_id").cumcount() + 1
    return st[st.rn <= cfg.sample_per_repo]


def ref_items(act, actors, repos, types, cfg):
    ev = act[(act.platform == cfg.platform) & act.type.isin(types) & in_win(act, cfg)
             & act.actor_id.isin(actors) & act.repo_id.isin(repos)]
    out = {}
    for r in ev.itertuples():
        key = None if pd.isna(r.issue_number) else f"{r.repo_id}#{int(r.issue_number)}"
        out[(r.actor_id, r.repo_id, key)] = out.get((r.actor_id, r.repo_id, key), 0) + 1
    return out


def ref_repo_features(act, repos, cfg):
    ev = act[(act.platform == cfg.platform) & act.type.isin(cfg.repo_feature_types) & act.repo_id.isin(repos)]
    ev = ev.sort_values(["created_at", "event_id"], ascending=[False, False])
    out = set()
    for repo, g in ev.groupby("repo_id"):
        top = g.iloc[0]
        topics = None if top.repo_topics is None else tuple(top.repo_topics)
        out.add((repo, top.repo_language, topics, top.repo_description))
    return out


def ref_actor_features(act, actors, cfg):
    ev = act[(act.platform == cfg.platform) & act.type.isin(cfg.actor_feature_types) & act.actor_id.isin(actors)]
    out = set()
    for actor, g in ev.groupby("actor_id"):
        counts = {}
        for lang in g.repo_language:
            if lang is not None and lang != "":
                counts[lang] = counts.get(lang, 0) + 1
        top = sorted(counts, key=lambda lang: (-counts[lang], lang))[:cfg.top_languages]
        topics = sorted({t for arr in g.repo_topics if arr for t in arr if t is not None})
        if top and topics:
            out.add((actor, tuple(sorted(top)), tuple(topics)))
    return out


# ---------------------------------------------------------------- comparisons

CONFIGS = [
    dict(top_n=3, sample_per_repo=3, pinned_orgs=("org1",), pinned_names=("o0/n3",)),
    dict(top_n=2, offset=1, sample_per_repo=1, pinned_orgs=(), pinned_names=("o2/n2-old",), entity_type="Repo"),
    dict(top_n=5, sample_per_repo=4, pinned_orgs=("org0", "org3"), pinned_names=(), broadcast_max_rows=0),
    # both two-round paths forced (input spread over several tasks)
    dict(top_n=4, offset=1, sample_per_repo=5, pinned_orgs=("org2",), pinned_names=(), topk_fan_in=3,
         topn_fan_in=2),
]


@pytest.mark.parametrize("seed,conf,hot", [(s, c, 0.0) for s in (11, 12) for c in range(len(CONFIGS))]
                         + [(13, 3, 1 / 3), (14, 0, 1 / 3)])
def test_operators_match_pandas(spark, seed, conf, hot):
    cfg = ExtractConfig.for_years(2022, 2023, **CONFIGS[conf])
    acts, scores = make_data(seed, hot_share=hot)
    act, sc, pact, psc = frames(spark, acts, scores)

    cand = ref_candidates(psc, cfg)
    assert {r[0] for r in C.candidates(sc, cfg).collect()} == cand

    for windowed in (False, True):
        co = build_cohort(sc, act, cfg, windowed=windowed)
        want = ref_sample(pact, cand, cfg, windowed)
        got = {(r.repo_id, r.event_id, r.rn) for r in co.sample.df.collect()}
        assert got == set(zip(want.repo_id, want.event_id, want.rn))
        actors, repos = set(want.actor_id), set(want.repo_id)
        assert {r[0] for r in C.actor_nodes(co.sample).collect()} == actors

        for kind, types in (("pr", cfg.pr_types), ("issue", cfg.issue_types)):
            ev = (E.pr_events if kind == "pr" else E.issue_events)(act, co.actors, co.repos, cfg)
            key = E.PR_KEY if kind == "pr" else E.ISSUE_KEY
            got_w = {(r.actor_id, r.repo_id, r[key]): r.weight for r in E.weighted_edges(ev, key, True).collect()}
            assert got_w == ref_items(pact, actors, repos, types, cfg)

        forks = ref_items(pact, actors, repos, cfg.fork_types, cfg)
        assert {tuple(r) for r in E.fork_edges(act, co.actors, co.repos, cfg).collect()} == \
            {(a, r) for a, r, _ in forks}

        got_rf = {(r.repo_id, r.repo_language, None if r.repo_topics is None else tuple(r.repo_topics),
                   r.repo_description) for r in FT.repo_features(act, co.repos, cfg).collect()}
        assert got_rf == ref_repo_features(pact, repos, cfg)

        fev = FT.actor_feature_events(act, co.actors, cfg)
        got_af = {(r.actor_id, tuple(r.languages), tuple(r.topics)) for r in FT.actor_features(fev, cfg).collect()}
        assert got_af == ref_actor_features(pact, actors, cfg)


def test_graph_matches_pandas(spark):
    cfg = ExtractConfig.for_years(2022, 2023, **CONFIGS[0])
    acts, scores = make_data(21)
    act, sc, pact, psc = frames(spark, acts, scores)
    g = extract_graph(sc, act, cfg)
    cand = ref_candidates(psc, cfg)
    base, win = ref_sample(pact, cand, cfg, False), ref_sample(pact, cand, cfg, True)
    assert {r[0] for r in g["actor"].collect()} == set(base.actor_id)
    assert {tuple(r) for r in g["actor_star_repo"].collect()} == set(zip(win.actor_id, win.repo_id))
    pr = ref_items(pact, set(base.actor_id), set(base.repo_id), cfg.pr_types, cfg)
    assert {(r.actor_id, r.repo_id, r.pr_id): r.weight
            for r in g["actor_contribute_pr_belong_repo"].collect()} == pr
    assert {(r.pr_id, r.repo_id) for r in g["pr_belong_repo"].collect()} == {(k, r) for _, r, k in pr}
    assert {(r.actor_id, tuple(r.languages), tuple(r.topics)) for r in g["actor_with_feature"].collect()} == \
        ref_actor_features(pact, set(base.actor_id), cfg)
    g.release()
