"""The newest star events of every repository, kept as a stored table and brought up to date.

``sample_recent`` ranks the whole history. A log that grows by a day at a time needs
that once: the newest K of a union are the newest K of the parts' newest K, so a
stored table of them takes a new day by merging the day's own newest K into it.

``StarState`` keeps, per repository and year, the newest ``sample_per_repo`` star
events of one platform, whatever repositories are candidates at the time, and a
ledger of the files it has taken. ``ingest`` reads only files that are not in the
ledger, and of the state only the years which their events fall in (late events
reach back into older years); other years stay where they are. Years are folders,
so the sample of a window of whole years opens these years' folders only, and the
all-time sample merges the years. A commit (``functions.commits``) names the
folders of a version; a step that fails leaves the former version.

Defined cases: an event of no time lies in a year of its own and is older than all
others; events of no repository are left out, as no candidate has them. An event
delivered twice counts twice, as in ``sample_recent``, or once with
``distinct_events``. A file that changed after it was taken is an error, as is a
state opened with other parameters or asked for a window of broken years. An empty
log gives an empty sample.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import YEAR_COLUMN, ExtractConfig
from ..functions import commits
from ..functions.joins import Sized, drop_materialized, materialize, restrict_to
from ..functions.topk import top_k_per_group
from ..operators.cohort import star_events
from ..sources.tables import normalise_activity

COLUMNS = "actor_id bigint, repo_id bigint, created_at timestamp_ntz, event_id bigint"
LEDGER = "path string, length bigint, modified timestamp"
#: Folder of the events without a time.
NO_YEAR = -1
#: Ledger folders of a version before they are written anew as one.
MAX_LEDGERS = 64


def _newest(stars: DataFrame, groups: list[str], cfg: ExtractConfig) -> DataFrame:
    return top_k_per_group(stars, groups, [F.col("created_at").desc(), F.col("event_id").desc()],
                           cfg.sample_per_repo, rank_col="rn", fan_in=cfg.topk_fan_in)


def _with_year(stars: DataFrame) -> DataFrame:
    return stars.withColumn(YEAR_COLUMN, F.coalesce(F.year("created_at"), F.lit(NO_YEAR)))


@dataclass(frozen=True)
class StarState:
    """One stored state: a folder, the parameters it was made with, and how repeated events count."""

    spark: SparkSession
    path: str
    cfg: ExtractConfig
    distinct_events: bool = False

    def _parameters(self) -> dict:
        return {"platform": self.cfg.platform, "star_types": sorted(self.cfg.star_types),
                "sample_per_repo": self.cfg.sample_per_repo, "distinct_events": self.distinct_events}

    def _version(self) -> tuple[int, dict]:
        number, content = commits.latest(self.spark, self.path)
        if content is None:
            return 0, {"parameters": self._parameters(), "years": {}, "ledgers": []}
        if content["parameters"] != self._parameters():
            raise ValueError(f"{self.path} was made with {content['parameters']}, not {self._parameters()}")
        return number, content

    def _read(self, folders, schema: str) -> DataFrame:
        paths = [f"{self.path.rstrip('/')}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """Number of committed steps; 0 for a new state."""
        return self._version()[0]

    def ledger(self) -> DataFrame:
        """The files taken so far: path, length, modified."""
        return self._read(self._version()[1]["ledgers"], LEDGER)

    def new_files(self, log: str) -> DataFrame:
        """Files under ``log`` that the ledger does not hold; ValueError when a file of the ledger has changed."""
        return self._new_files(log, self._version()[1])

    def _new_files(self, log: str, content: dict) -> DataFrame:
        found = commits.listed_files(self.spark, log)
        taken = self._read(content["ledgers"], LEDGER)
        old = taken.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
        changed = (found.join(old, "path")
                   .where((F.col("length") != F.col("_length")) | (F.col("modified") != F.col("_modified"))))
        if (first := changed.select("path").first()) is not None:
            raise ValueError(f"{first.path} was changed after it was taken into {self.path}")
        return found.join(taken, "path", "left_anti")

    def ingest(self, log: str) -> int:
        """Take the files under ``log`` that are new; returns how many (0: no new version)."""
        number, content = self._version()
        files = materialize(self._new_files(log, content))
        written = [files]
        step = uuid.uuid4().hex
        base = self.path.rstrip("/")
        try:
            # as many paths as the reader's own file index holds
            paths = sorted(r.path for r in files.df.select("path").toLocalIterator())
            if not paths:
                return 0
            act = normalise_activity(self.spark.read.option("basePath", log).parquet(*paths))
            new = materialize(self._newest_of(act))
            written.append(new)
            touched = [str(r[0]) for r in new.df.select(YEAR_COLUMN).distinct().collect()]  # a few years
            years = dict(content["years"])
            if touched:
                stored = _with_year(self._read([years[y] for y in touched if y in years], COLUMNS))
                merged = self._merge(new.df.unionByName(stored))
                merged.write.partitionBy(YEAR_COLUMN).parquet(f"{base}/stars/{step}")
                years |= {y: f"stars/{step}/{YEAR_COLUMN}={y}" for y in touched}
            ledgers = [*content["ledgers"], f"files/{step}"]
            taken = files.df
            if len(ledgers) > MAX_LEDGERS:
                taken, ledgers = taken.unionByName(self._read(content["ledgers"], LEDGER)), ledgers[-1:]
            taken.write.parquet(f"{base}/files/{step}")
            commits.commit(self.spark, base, number + 1,
                           {"parameters": content["parameters"], "years": years, "ledgers": ledgers})
        except BaseException:
            for part in ("stars", "files"):
                commits.delete(self.spark, f"{base}/{part}/{step}")
            raise
        finally:
            drop_materialized(self.spark, written)
        return len(paths)

    def _newest_of(self, act: DataFrame) -> DataFrame:
        stars = star_events(act, self.cfg).where(F.col("repo_id").isNotNull())
        return self._merge(_with_year(stars.select("actor_id", "repo_id", "created_at", "event_id")))

    def _merge(self, stars: DataFrame) -> DataFrame:
        if self.distinct_events:
            stars = stars.distinct()  # spread by event, not by repository
        return _newest(stars, ["repo_id", YEAR_COLUMN], self.cfg).drop("rn")

    def _years_of_window(self, years) -> list[str]:
        start, end = self.cfg.start, self.cfg.end
        if any((t.month, t.day, t.hour, t.minute, t.second, t.microsecond) != (1, 1, 0, 0, 0, 0) for t in (start, end)):
            raise ValueError("the state holds whole years: the window must begin and end with a year")
        return [y for y in years if start.year <= int(y) < end.year]

    def sample(self, cand: DataFrame | Sized, windowed: bool = False) -> DataFrame:
        """``sample_recent`` over all files taken so far, from the state alone."""
        years = self._version()[1]["years"]
        names = self._years_of_window(years) if windowed else list(years)
        stars = self._read([years[y] for y in sorted(names)], COLUMNS)
        stars = restrict_to(stars, cand, "repo_id", self.cfg.broadcast_max_rows)
        return _newest(stars.select("actor_id", "repo_id", "created_at", "event_id"), ["repo_id"], self.cfg)

    def drop_old_versions(self) -> None:
        """Delete data folders that the newest version does not name (no reader may still use an older one)."""
        _, content = self._version()
        kept = {f.split("/")[1] for f in [*content["years"].values(), *content["ledgers"]]}
        for part in ("stars", "files"):
            for name in commits.names(self.spark, f"{self.path.rstrip('/')}/{part}"):
                if name not in kept:
                    commits.delete(self.spark, f"{self.path.rstrip('/')}/{part}/{name}")
