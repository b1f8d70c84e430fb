"""Condensed physical plans of one query per kind (writes PLANS.md).

    python -m tests.plan_report [sf_dir] > PLANS.md

Each plan is the adaptive plan's initial physical plan, one operator per line,
with expression ids and long argument lists trimmed, so the operators,
exchanges, broadcasts and pushed filters can be read at a glance.
"""

from __future__ import annotations

import re
import sys

# one query per kind: ranking, set union, top-k, semi joins, weighted edges, newest row, per-actor fold
NAMES = ("top_entities", "candidates", "star_sample", "fork_edges", "pr_edges", "repo_features", "actor_features")

KEEP = ("Exchange", "Broadcast", "Window", "Aggregate", "Join", "TakeOrdered", "Scan", "Expand", "Generate",
        "Union", "Sort", "Filter", "CollectLimit", "GlobalLimit", "Project")


def condense(plan: str) -> list[str]:
    out = []
    body = plan.split("== Physical Plan ==")[-1]
    for line in body.splitlines():
        if not line.strip() or "AdaptiveSparkPlan" in line:
            continue
        name = line.strip(" :+-")
        first = name.split(" ")[0].split("(")[0]
        if not any(k in first for k in KEEP):
            continue
        indent = len(line) - len(line.lstrip(" :+-"))
        text = re.sub(r"#\d+L?", "", line[indent:])
        text = re.sub(r", \[plan_id=\d+\]", "", text)
        if "Scan parquet" in text and "Location" in text:
            loc = re.search(r"\[file:[^\]]*/([^/\]]+)\]", text)
            pushed = re.search(r"PushedFilters: \[(.*?)\](?:, ReadSchema|$)", text)
            schema = re.search(r"ReadSchema: (struct<[^>]*>?)", text)
            source = "materialised intermediate (checkpoint folder)" if "/cohortgraph" in text else \
                (loc.group(1) if loc else "")
            text = "Scan parquet " + source + \
                   (f" pushed=[{pushed.group(1)[:160]}]" if pushed and pushed.group(1) else "") + \
                   (f" schema={schema.group(1)[:120]}" if schema else "")
        elif len(text) > 170:
            text = text[:167] + "..."
        out.append(" " * indent + text)
    return out


def main() -> None:
    from cohortgraph.plans.registry import QUERIES
    from cohortgraph.plans.checks import physical_plan
    from cohortgraph.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    print("# Physical plans, one query per kind\n")
    print(f"Generated by `python -m tests.plan_report {sf}` (local[*], 8 shuffle partitions). "
          "Each query is one plan, before adaptive execution; the cohort is part of it.\n")
    for name in NAMES:
        plan = physical_plan(QUERIES[name](spark, sf), "simple")
        print(f"## {name}\n\n```")
        print("\n".join(condense(plan)))
        print("```\n")

    from cohortgraph.functions.joins import materialize
    from cohortgraph.operators import cohort as C
    from cohortgraph.plans.graph import build_cohort, node_events_plan, node_keys, pass_one_plan
    from cohortgraph.sources.fixtures import fixture_inputs

    scores, act, cfg = fixture_inputs(spark, sf)
    cand = materialize(C.candidates(scores, cfg))
    base = build_cohort(scores, act, cfg, cand=cand)
    win = build_cohort(scores, act, cfg, windowed=True, cand=cand)
    extra = {
        "computation of the star sample (one round: few input tasks)": C.sample_recent(act, cand, cfg),
        "computation of the star sample (two rounds, fan-in 4, as on many input tasks)":
            C.sample_recent(act, cand, cfg.with_(topk_fan_in=4)),
        "extract_graph pass 1: newest stars of the candidates (written once)": pass_one_plan(act, cand, cfg),
        "extract_graph pass 2: node events (written once; every edge and feature table reads it)":
            node_events_plan(act, *node_keys([base, win]), cfg),
    }
    for title, df in extra.items():
        print(f"## {title}\n\n```")
        print("\n".join(condense(physical_plan(df, "simple"))))
        print("```\n")


if __name__ == "__main__":
    main()
