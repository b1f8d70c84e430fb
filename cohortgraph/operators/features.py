"""Initial node features.

Repository features: the newest profile (language, topics, description) among
the repository's pull-request-family events, over all time. Actor features:
the actor's top languages by event count and every distinct topic, from the
actor's ``cfg.actor_feature_types`` events, over all time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.columns import non_blank, non_empty, windowed_rows
from ..functions.joins import Sized, restrict_to
from ..functions.topk import top_k_per_group


def _typed(act: DataFrame, types, cfg: ExtractConfig, window: bool) -> DataFrame:
    cond = (F.col("platform") == cfg.platform) & F.col("type").isin(list(types))
    if window:
        cond = cond & windowed_rows(act, cfg.start, cfg.end)
    return act.filter(cond)


def _informative():
    return non_empty("repo_topics") | non_blank("repo_language")


def repo_features(act: DataFrame, repos: DataFrame | Sized, cfg: ExtractConfig,
                  non_blank_only: bool = False, window: bool = False) -> DataFrame:
    """Newest (language, topics, description) of each node repository.

    Repositories without any such event drop out. ``non_blank_only`` keeps only
    events with a topic or a language *before* picking the newest one.
    """
    ev = _typed(act, cfg.repo_feature_types, cfg, window)
    if non_blank_only:
        ev = ev.filter(_informative())
    # rank narrow rows; the profile is fetched for the winners only, at most one per repository
    keys = restrict_to(ev.select("repo_id", "created_at", "event_id"), repos, "repo_id", cfg.broadcast_max_rows)
    newest = top_k_per_group(keys, ["repo_id"], [F.col("created_at").desc(), F.col("event_id").desc()], 1,
                             fan_in=cfg.topk_fan_in)
    newest = newest.select(F.col("repo_id").alias("__repo"), F.col("created_at").alias("__at"), F.col("event_id").alias("__event"))
    fetched = (ev.select("repo_id", "created_at", "event_id", "repo_language", "repo_topics", "repo_description")
               .join(newest, (F.col("repo_id") == F.col("__repo")) & F.col("created_at").eqNullSafe(F.col("__at"))
                     & F.col("event_id").eqNullSafe(F.col("__event")), "left_semi"))
    # an event may be delivered twice, or several newest ones have no id: one row per repository
    columns = ["repo_language", "repo_topics", "repo_description"]
    return (fetched.groupBy("repo_id").agg(F.max(F.struct(*columns)).alias("profile"))
            .select("repo_id", *[F.col(f"profile.{c}").alias(c) for c in columns]))


def repo_feature_count(act: DataFrame, repos: DataFrame | Sized, cfg: ExtractConfig,
                       window: bool = False) -> DataFrame:
    """One row: repositories with a feature row, and those with a topic or language.

    Equal to counting ``repo_features`` with ``non_blank_only`` off and on, but
    one hash aggregation instead of two rankings.
    """
    ev = _typed(act, cfg.repo_feature_types, cfg, window)
    ev = restrict_to(ev.select("repo_id", _informative().alias("informative")), repos, "repo_id",
                     cfg.broadcast_max_rows)
    per_repo = ev.groupBy("repo_id").agg(F.max(F.col("informative").cast("int")).alias("informative"))
    return per_repo.agg(F.count(F.lit(1)).alias("repos_with_features"),
                        F.coalesce(F.sum("informative"), F.lit(0)).cast("bigint")
                        .alias("repos_with_topic_or_language"))


def actor_feature_events(act: DataFrame, actors: DataFrame | Sized, cfg: ExtractConfig,
                         window: bool = False) -> DataFrame:
    """The node actors' feature events: actor_id, repo_language, repo_topics."""
    ev = _typed(act, cfg.actor_feature_types, cfg, window).select("actor_id", "repo_language", "repo_topics")
    return restrict_to(ev, actors, "actor_id", cfg.broadcast_max_rows)


def actor_language_ranks(events: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """Top ``cfg.top_languages`` non-blank languages per actor by event count.

    Ties on the count go to the alphabetically first language. Counts are
    aggregated map-side; the ranking window then sees one row per
    (actor, language), so no actor group is larger than the language count.
    """
    counts = (events.filter(non_blank("repo_language"))
              .groupBy("actor_id", "repo_language")
              .agg(F.count(F.lit(1)).alias("language_count")))
    w = Window.partitionBy("actor_id").orderBy(F.col("language_count").desc(), F.col("repo_language").asc())
    return (counts.withColumn("language_rank", F.row_number().over(w))
            .filter(F.col("language_rank") <= cfg.top_languages))


def actor_topics(events: DataFrame) -> DataFrame:
    """Distinct (actor, topic) pairs from non-empty topic arrays."""
    return (events.filter(non_empty("repo_topics"))
            .select("actor_id", F.explode("repo_topics").alias("topic"))
            .filter(F.col("topic").isNotNull())
            .distinct())


_JOIN_KEEPS = {
    "inner": lambda has_l, has_t: has_l & has_t,
    "left": lambda has_l, has_t: has_l,
    "right": lambda has_l, has_t: has_t,
    "outer": lambda has_l, has_t: has_l | has_t,
    "full": lambda has_l, has_t: has_l | has_t,
}


def actor_features(events: DataFrame, cfg: ExtractConfig, how: str = "inner") -> DataFrame:
    """actor_id, languages (top languages), topics (all distinct topics).

    Both arrays are sorted ascending. With ``how='inner'`` only actors having
    both a ranked language and a topic are kept; ``left`` / ``right`` /
    ``outer`` keep actors with languages / topics / either, the missing side
    being NULL - the rows a join of the two per-actor tables would give.

    One scan and two shuffles: the events are aggregated per (actor,
    language) into an event count and the set of distinct topics (buffers
    bounded by the topic vocabulary, de-duplicated map-side); languages are
    ranked per actor (blank ones last and never kept); a final per-actor fold,
    on the partitioning the ranking already produced, keeps the top languages
    and merges the topic sets, each topic once. An actor's buffers hold at most
    its distinct languages and distinct topics, however active it is.
    """
    if how not in _JOIN_KEEPS:
        raise ValueError(f"how must be one of {sorted(_JOIN_KEEPS)}")
    lang = F.col("repo_language")
    # one row per (event, topic); an event without topics keeps one row with a
    # NULL position, so "position NULL or 0" counts each event exactly once
    exploded = events.select("actor_id", "repo_language",
                             F.posexplode_outer("repo_topics").alias("pos", "topic"))
    first_of_event = F.col("pos").isNull() | (F.col("pos") == 0)
    per_lang = exploded.groupBy("actor_id", "repo_language").agg(
        F.count(F.when(first_of_event, F.lit(1))).alias("n"),
        F.collect_set("topic").alias("topic_set"))
    blank = F.when(non_blank("repo_language"), F.lit(0)).otherwise(F.lit(1))
    w = Window.partitionBy("actor_id").orderBy(blank.asc(), F.col("n").desc(), lang.asc())
    ranked = per_lang.withColumn("rank", F.row_number().over(w))
    keep_lang = non_blank("repo_language") & (F.col("rank") <= cfg.top_languages)
    merged = ranked.select("actor_id", F.when(keep_lang, lang).alias("language"), F.explode_outer("topic_set").alias("topic"))
    folded = merged.groupBy("actor_id").agg(F.collect_set("language").alias("languages"), F.collect_set("topic").alias("topics"))
    out = folded.select("actor_id", F.array_sort("languages").alias("languages"), F.array_sort("topics").alias("topics"))
    has_l, has_t = F.size("languages") > 0, F.size("topics") > 0
    out = out.filter(_JOIN_KEEPS[how](has_l, has_t))
    return out.select("actor_id",
                      F.when(has_l, F.col("languages")).alias("languages"),
                      F.when(has_t, F.col("topics")).alias("topics"))


def actor_history(act: DataFrame, actor_id: int, cfg: ExtractConfig) -> DataFrame:
    """Drill-down: language and topics of one actor's pull-request-family events."""
    return (act.filter((F.col("platform") == cfg.platform)
                       & F.col("type").isin(list(cfg.pr_types))
                       & (F.col("actor_id") == F.lit(actor_id)))
            .select("actor_id", "repo_language", "repo_topics"))
