"""One extraction run: every graph table from one shared cohort, in two passes.

The activity log is the big input, so the run reads it twice, not once per
output table, whatever the size of the node sets:

1. The candidates' star events are cut to the newest ``sample_per_repo`` inside
   and outside the window per repository and written: at most twice that many
   rows per repository. Both star samples follow from this small table.
2. Once the node sets are known, every event that an output table needs is
   written once, in slices: ``edge`` (in-window fork / pull-request / issue events
   between nodes: ids, number and type only), ``repo`` (feature events of node
   repositories: profile columns) and ``actor`` (feature events of node actors:
   language and topics). Each slice is a folder of its own and holds nulls
   where it needs no payload, so a table reads only its slice.

An OR of two key sets is not a semi join; it is expressed as two left joins
against the key sets, carrying a flag. The joins are broadcast when the key
set's counted size allows it, and shuffle joins otherwise.

The pull-request and issue families are aggregated once per (actor, repository,
item) and written; edges with and without the repository and the membership
follow from that table.

Intermediates are parquet tables under ``spark.checkpoint.dir`` (see
``functions.joins.materialize``); they are released if a step fails. A run with a
``run_dir`` keeps them there instead and can be taken up again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ExtractConfig
from ..functions import commits
from ..functions.columns import windowed_rows
from ..functions.joins import Sized, drop_materialized, key_side, materialize, tighten
from ..operators import cohort as C
from ..operators import edges as E
from ..operators import features as FT
from .resume import RunFolder, fingerprint

EDGE, REPO, ACTOR = "edge", "repo", "actor"
SLICE = "slice"

# the tables of one run, and the slices each reads beside the star samples
TABLES = {
    "actor": (), "repo": (), "actor_star_repo": (), "actor_fork_repo": (EDGE,),
    "actor_contribute_pr": (EDGE,), "actor_contribute_pr_belong_repo": (EDGE,),
    "actor_discussion_issue": (EDGE,), "actor_discussion_issue_belong_repo": (EDGE,),
    "pr_belong_repo": (EDGE,), "issue_belong_repo": (EDGE,),
    "repo_with_feature": (REPO,), "actor_with_feature": (ACTOR,),
}


@dataclass(frozen=True)
class Cohort:
    """Candidates, one star sample and its node key sets, with checked sizes."""

    cfg: ExtractConfig
    candidates: Sized
    sample: Sized
    windowed: bool
    actors: Sized
    repos: Sized

    @property
    def materialized(self) -> list[Sized]:
        """The intermediate tables this cohort wrote (candidates excluded)."""
        return [s for s in (self.sample, self.actors, self.repos) if s.path is not None]


def _unnamed(name: str, df: DataFrame, partition_by: str | None = None) -> Sized:
    """A step's result as an intermediate of this run only."""
    return materialize(df, partition_by)


def make_cohort(cfg: ExtractConfig, cand: Sized, sample: Sized, windowed: bool, step=_unnamed) -> Cohort:
    """Node key sets of a materialised sample, with bounds tight enough to broadcast.

    Actors are at most the sampled events and repositories at most the
    candidates; when such a bound exceeds the broadcast limit the distinct
    keys are counted exactly (``tighten``).
    """
    limit, which = cfg.broadcast_max_rows, "windowed" if windowed else "all_time"
    actors = tighten(Sized(C.actor_set(sample), sample.rows), "actor_id", limit, partial(step, f"{which}_actors"))
    repos = tighten(Sized(C.repo_set(sample), min(sample.rows, cand.rows)), "repo_id", limit,
                    partial(step, f"{which}_repos"))
    return Cohort(cfg, cand, sample, windowed, actors, repos)


def build_cohort(scores: DataFrame, act: DataFrame, cfg: ExtractConfig, windowed: bool = False,
                 cand: Sized | None = None) -> Cohort:
    """Candidates (materialised unless given), one materialised star sample, its node sets."""
    cand = cand if cand is not None else materialize(C.candidates(scores, cfg))
    sample = materialize(C.sample_recent(act, cand, cfg, windowed=windowed))
    return make_cohort(cfg, cand, sample, windowed)


def _union_keys(a: Sized, b: Sized, key: str, limit: int, step=_unnamed) -> Sized:
    if a is b or a.df is b.df:
        return a
    return tighten(Sized(a.df.select(key).union(b.df.select(key)).distinct(), a.rows + b.rows), key, limit,
                   partial(step, f"node_{key}"))


def node_keys(cohorts: list[Cohort], step=_unnamed) -> tuple[Sized, Sized]:
    repos, actors = cohorts[0].repos, cohorts[0].actors
    limit = cohorts[0].cfg.broadcast_max_rows
    for c in cohorts[1:]:
        repos = _union_keys(repos, c.repos, "repo_id", limit, step)
        actors = _union_keys(actors, c.actors, "actor_id", limit, step)
    return repos, actors


def pass_one_plan(act: DataFrame, cand: Sized, cfg: ExtractConfig) -> DataFrame:
    """Pass 1, lazily: the candidates' newest stars inside and outside the window."""
    return C.newest_in_and_out(C.candidate_stars(act, cand, cfg), cfg).drop("rn")


def samples(newest: DataFrame, cfg: ExtractConfig) -> tuple[DataFrame, DataFrame]:
    """(in-window sample, all-time sample) from the rows of pass 1."""
    inside = C.newest_per_repo(newest.where("in_window").drop("in_window"), cfg)
    return inside, C.newest_per_repo(newest.drop("in_window"), cfg)


def node_events_plan(act: DataFrame, repos: Sized, actors: Sized, cfg: ExtractConfig,
                     slices: Iterable[str] = (EDGE, REPO, ACTOR)) -> DataFrame:
    """Pass 2, lazily: one row per event and slice that an output table reads."""
    slices, typ = set(slices), F.col("type")
    edge_types = list(dict.fromkeys([*cfg.fork_types, *cfg.pr_types, *cfg.issue_types]))
    of = {EDGE: edge_types, REPO: list(cfg.repo_feature_types), ACTOR: list(cfg.actor_feature_types)}
    types = list(dict.fromkeys(t for s in sorted(slices) for t in of[s]))
    ev = act.filter((F.col("platform") == cfg.platform) & typ.isin(types))
    limit = cfg.broadcast_max_rows
    repo_flag = key_side(Sized(repos.df.select("repo_id").withColumn("_node_repo", F.lit(True)), repos.rows), limit)
    actor_flag = key_side(Sized(actors.df.select("actor_id").withColumn("_node_actor", F.lit(True)), actors.rows), limit)
    is_repo, is_actor = F.col("_node_repo").isNotNull(), F.col("_node_actor").isNotNull()
    inside = windowed_rows(ev, cfg.start, cfg.end)
    wanted = {EDGE: typ.isin(edge_types) & inside & is_repo & is_actor, REPO: typ.isin(of[REPO]) & is_repo,
              ACTOR: typ.isin(of[ACTOR]) & is_actor}
    marks = F.array_compact(F.array(*[F.when(wanted[s], F.lit(s)) for s in sorted(slices)]))
    joined = (ev.join(repo_flag, "repo_id", "left").join(actor_flag, "actor_id", "left")
              .withColumn(SLICE, F.explode(marks)))

    def only(name: str, *where: str):
        return F.when(F.col(SLICE).isin(list(where)), F.col(name)).alias(name)

    return joined.select(
        "event_id", "actor_id", "repo_id", "created_at", "platform", "type", only("issue_number", EDGE),
        only("repo_language", REPO, ACTOR), only("repo_topics", REPO, ACTOR), only("repo_description", REPO), SLICE)


class GraphTables(dict):
    """Table name -> DataFrame, plus the materialised intermediates the tables read."""

    def __init__(self, tables: dict[str, DataFrame], intermediates: list[Sized], run: RunFolder | None = None):
        super().__init__(tables)
        self.intermediates = intermediates
        self.run = run

    def release(self) -> None:
        """Delete the intermediate tables; the DataFrames are unusable afterwards."""
        if self.run is not None:
            self.run.release()  # with the record of its steps, or a later run would trust it
            self.intermediates = []
        if self.intermediates:
            drop_materialized(self.intermediates[0].df.sparkSession, self.intermediates)
            self.intermediates = []


def checked_tables(tables: Iterable[str] | None) -> list[str]:
    """The wanted table names in their fixed order; ValueError for an unknown one."""
    wanted = set(TABLES) if tables is None else set(tables)
    if unknown := wanted - set(TABLES):
        raise ValueError(f"unknown tables: {sorted(unknown)}; choose from {sorted(TABLES)}")
    return [t for t in TABLES if t in wanted]


def extract_graph(scores: DataFrame, act: DataFrame, cfg: ExtractConfig, consistent: bool = False,
                  tables: Iterable[str] | None = None, run_dir: str | None = None,
                  inputs: str | None = None) -> GraphTables:
    """The graph tables (all, or those named), keyed by table name.

    With ``consistent=False`` the node sets, PR/issue edges and features use the
    all-time star sample while star and fork edges use the in-window sample,
    as the source scripts do; an edge endpoint can then be missing from the
    node list. ``consistent=True`` uses the in-window sample everywhere. Only the
    slices and aggregates that the named tables need are computed.

    With ``run_dir`` the run can be taken up again: intermediates lie there, in a
    folder of the fingerprint of the inputs' files and all parameters, each
    recorded when it is whole. After a failure, or the loss of the driver, the
    same call goes on behind the last recorded step; other inputs or parameters
    have a folder of their own. ``inputs`` stands for the inputs' state where they
    have no files (see ``resume.fingerprint``).
    """
    wanted = checked_tables(tables)
    if run_dir is not None:
        spark = act.sparkSession
        key = fingerprint(spark, {"scores": scores, "activity": act}, [cfg, consistent, wanted], inputs)
        run = RunFolder(spark, f"{run_dir.rstrip('/')}/{key}")
        return GraphTables(_tables(scores, act, cfg, consistent, wanted, lambda s: s, run.step), [], run)
    kept: list[Sized] = []

    def keep(s: Sized) -> Sized:
        if s.path is not None and s not in kept:
            kept.append(s)
        return s

    try:
        return GraphTables(_tables(scores, act, cfg, consistent, wanted, keep), kept)
    except BaseException:
        if kept:
            drop_materialized(act.sparkSession, kept)
        raise


def _tables(scores, act, cfg, consistent, wanted, keep, step=_unnamed) -> dict[str, DataFrame]:
    cand = keep(step("candidates", C.candidates(scores, cfg)))
    newest = keep(step("newest", pass_one_plan(act, cand, cfg)))
    inside, all_time = samples(newest.df, cfg)
    windowed = make_cohort(cfg, cand, keep(step("windowed_sample", inside)), True, step)
    base = windowed if consistent else make_cohort(cfg, cand, keep(step("all_time_sample", all_time)), False, step)
    cohorts = [base] if consistent else [base, windowed]
    for c in cohorts:
        for s in c.materialized:
            keep(s)

    slices = {s for t in wanted for s in TABLES[t]}
    of: dict[str, DataFrame] = {}
    if slices:
        node_repos, node_actors = (keep(k) for k in node_keys(cohorts, step))
        plan = node_events_plan(act, node_repos, node_actors, cfg, slices)
        written = keep(step("node_events", plan, partition_by=SLICE))
        of = {s: written.df.where(F.col(SLICE) == s).drop(SLICE) for s in slices}

    def weights(kind: str) -> DataFrame:
        """The family's events per (actor, repository, item), aggregated and written once."""
        if kind not in of:
            events, key = (E.pr_events, E.PR_KEY) if kind == "pr" else (E.issue_events, E.ISSUE_KEY)
            plan = E.item_weights(events(of[EDGE], base.actors, base.repos, cfg), key)
            of[kind] = keep(step(f"{kind}_weights", plan)).df
        return of[kind]

    make = {
        "actor": lambda: C.actor_nodes(base.sample),
        "repo": lambda: C.repo_nodes(base.sample),
        "actor_star_repo": lambda: E.star_edges(windowed.sample),
        "actor_fork_repo": lambda: E.fork_edges(of[EDGE], windowed.actors, windowed.repos, cfg),
        "actor_contribute_pr": lambda: weights("pr").drop("repo_id"),
        "actor_contribute_pr_belong_repo": lambda: weights("pr"),
        "actor_discussion_issue": lambda: weights("issue").drop("repo_id"),
        "actor_discussion_issue_belong_repo": lambda: weights("issue"),
        "pr_belong_repo": lambda: E.membership(weights("pr"), E.PR_KEY),
        "issue_belong_repo": lambda: E.membership(weights("issue"), E.ISSUE_KEY),
        "repo_with_feature": lambda: FT.repo_features(of[REPO], base.repos, cfg),
        "actor_with_feature": lambda: FT.actor_features(FT.actor_feature_events(of[ACTOR], base.actors, cfg), cfg),
    }
    return {t: make[t]() for t in wanted}


def _csv_ready(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays: array columns become JSON text."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def write_graph(graph: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
                mode: str = "error", release: bool = False, parallel_jobs: int = 4) -> dict[str, str]:
    """Write every table to ``out_dir/<name>`` (parquet by default, or csv with a header).

    The tables are independent jobs over the shared intermediates; up to
    ``parallel_jobs`` of them are submitted at once (Spark runs jobs from
    different threads concurrently), so small tables do not leave the
    cluster idle. An existing folder is an error unless ``mode`` says otherwise.
    ``release=True`` deletes the run's intermediate tables afterwards, also
    when a write failed.
    """
    def write_one(item):
        name, df = item
        path = f"{out_dir.rstrip('/')}/{name}"
        if fmt == "csv":
            _csv_ready(df).write.mode(mode).option("header", "true").csv(path)
        else:
            df.write.mode(mode).format(fmt).save(path)
        return name, path

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallel_jobs)) as pool:
            return dict(pool.map(write_one, list(graph.items())))
    finally:
        if release and isinstance(graph, GraphTables):
            graph.release()


def publish_graph(graph: dict[str, DataFrame], out_dir: str, fmt: str = "parquet", release: bool = False,
                  parallel_jobs: int = 4) -> int:
    """Write every table to a new folder and make it the current graph of ``out_dir``; returns its number.

    The tables become visible together, by one commit that is put in place when
    all are whole: ``read_graph`` gives the former graph until then. A failed run
    leaves no commit, and its folder is deleted.
    """
    spark = next(iter(graph.values())).sparkSession
    base, folder = out_dir.rstrip("/"), f"graphs/{uuid.uuid4().hex}"
    try:
        # taken now: of two runs that start from the same graph, the slower one fails
        number = commits.latest(spark, base)[0] + 1
        schemas = {t: (_csv_ready(df) if fmt == "csv" else df).schema.jsonValue() for t, df in graph.items()}
        write_graph(graph, f"{base}/{folder}", fmt, parallel_jobs=parallel_jobs)
        commits.commit(spark, base, number, {"folder": folder, "format": fmt, "schemas": schemas})
    except BaseException:
        commits.delete(spark, f"{base}/{folder}")
        raise
    if release and isinstance(graph, GraphTables):
        graph.release()  # after a failure they stay: the run can be taken up again
    return number


def read_graph(spark, out_dir: str) -> dict[str, DataFrame]:
    """The current graph of ``out_dir`` as ``publish_graph`` wrote it (csv: arrays as JSON text); empty when there is none."""
    base = out_dir.rstrip("/")
    _, content = commits.latest(spark, base)
    if content is None:
        return {}
    reader = spark.read.format(content["format"]).options(**({"header": "true"} if content["format"] == "csv" else {}))
    return {t: reader.schema(T.StructType.fromJson(s)).load(f"{base}/{content['folder']}/{t}")
            for t, s in content["schemas"].items()}
