"""Command-line job: extract the graph tables and write them.

    spark-submit --py-files cohortgraph.zip cohortgraph/__main__.py \\
        --scores PATH --activity PATH --out DIR \\
        --start-year 2022 --end-year 2023 --top-n 10000 --sample 500 --format csv

(or ``python -m cohortgraph ...`` where pyspark is installed). The session
comes from ``SparkSession.builder.getOrCreate()``, so cluster settings -
including ``spark.checkpoint.dir`` for the intermediates - come from the
submission.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from cohortgraph.config import PINNED_NAMES, PINNED_ORGS, ExtractConfig
from cohortgraph.plans.graph import checked_tables, extract_graph, publish_graph, write_graph
from cohortgraph.session import DEFAULT_CONF
from cohortgraph.sources.tables import read_activity, read_scores


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cohortgraph", description=__doc__.split("\n\n")[0])
    p.add_argument("--scores", required=True, help="score history: path, or table name with --scores-format table")
    p.add_argument("--activity", required=True, help="event log: path, or table name with --activity-format table")
    p.add_argument("--scores-format", default="parquet")
    p.add_argument("--activity-format", default="parquet")
    p.add_argument("--reader-option", action="append", default=[], metavar="KEY=VALUE",
                   help="option for both readers, e.g. header=true for CSV inputs (repeatable)")
    p.add_argument("--out", required=True, help="output folder; one sub-folder per table")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "orc", "json"])
    p.add_argument("--mode", default="error", choices=["error", "overwrite", "append", "ignore"],
                   help="what to do with an output folder that exists")
    p.add_argument("--start-year", type=int, default=2022)
    p.add_argument("--end-year", type=int, default=2023, help="exclusive")
    p.add_argument("--top-n", type=int, default=10000)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--sample", type=int, default=500, help="newest star events kept per repository")
    p.add_argument("--pinned-org", action="append", help="pinned organisation (repeatable)")
    p.add_argument("--pinned-name", action="append", help="pinned repository name (repeatable)")
    p.add_argument("--entity-type", default=None, help="keep only score rows of this type, e.g. Repo")
    p.add_argument("--consistent", action="store_true", help="use the in-window sample for every table")
    p.add_argument("--tables", default="", help="comma-separated subset of the tables; only what they need is computed")
    p.add_argument("--run-dir", default=None,
                   help="shared folder that keeps finished steps, so that the same call goes on after a failure")
    p.add_argument("--publish", action="store_true",
                   help="write a new folder in --out and make it the current graph by one commit (read_graph)")
    p.add_argument("--keep-intermediates", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = parse_args(argv)
    try:  # before any job runs
        wanted = checked_tables([t for t in args.tables.split(",") if t] or None)
    except ValueError as error:
        raise SystemExit(str(error)) from None
    if spark is None:
        builder = SparkSession.builder.appName("cohortgraph")
        for k, v in DEFAULT_CONF.items():
            if k != "spark.ui.enabled":  # leave UI policy to the cluster
                builder = builder.config(k, v)
        spark = builder.getOrCreate()
    cfg = ExtractConfig.for_years(
        args.start_year, args.end_year, top_n=args.top_n, offset=args.offset, sample_per_repo=args.sample,
        pinned_orgs=tuple(args.pinned_org) if args.pinned_org is not None else PINNED_ORGS,
        pinned_names=tuple(args.pinned_name) if args.pinned_name is not None else PINNED_NAMES,
        entity_type=args.entity_type)
    options = dict(opt.split("=", 1) for opt in args.reader_option)
    scores = read_scores(spark, args.scores, args.scores_format, **options)
    act = read_activity(spark, args.activity, args.activity_format, **options)
    graph = extract_graph(scores, act, cfg, consistent=args.consistent, tables=wanted,
                          run_dir=args.run_dir)
    if args.publish:
        number = publish_graph(graph, args.out, fmt=args.format, release=not args.keep_intermediates)
        print(json.dumps({"published": number}))
        return {}
    paths = write_graph(graph, args.out, fmt=args.format, mode=args.mode, release=not args.keep_intermediates)
    print(json.dumps(paths))
    return paths


if __name__ == "__main__":
    main(sys.argv[1:])
