"""Extraction parameters.

Every knob of the extraction lives in one frozen dataclass. Values reach Spark
as literals inside Column expressions, never through string templating.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source scripts' literals for the results
# to match: the platform, the event-type vocabulary, the pinned organisations
# and repository names, and the documented default parameters.
# ---------------------------------------------------------------------------
PLATFORM = "GitHub"
STAR_TYPES = ("WatchEvent",)
FORK_TYPES = ("ForkEvent",)
PR_TYPES = ("PullRequestEvent", "PullRequestReviewEvent", "PullRequestReviewCommentEvent")
ISSUE_TYPES = ("IssuesEvent", "IssuesReactionEvent", "IssueCommentEvent")
ACTOR_FEATURE_TYPES = ("PullRequestEvent",)
PINNED_ORGS = ("polardb", "X-lab2017")
PINNED_NAMES = ("ClickHouse/ClickHouse", "apache/doris", "ingcap/tidb")
DEFAULT_TOP_N = 10000
DEFAULT_OFFSET = 0
DEFAULT_START_YEAR = 2022
DEFAULT_END_YEAR = 2023  # exclusive
DEFAULT_SAMPLE_PER_REPO = 500
DEFAULT_TOP_LANGUAGES = 3
ITEM_KEY_SEPARATOR = "#"

# folder level of the stored layouts: the year of ``created_at``
YEAR_COLUMN = "event_year"


def year_start(year: int) -> datetime:
    return datetime(year, 1, 1)


@dataclass(frozen=True)
class ExtractConfig:
    """Parameters of one graph extraction.

    ``start``/``end`` form the half-open time window ``[start, end)`` used for
    the score average and for the windowed edge tables. ``top_n``/``offset``
    slice the ranked repositories. ``sample_per_repo`` is the number of most
    recent star events kept per repository.
    """

    top_n: int = DEFAULT_TOP_N
    offset: int = DEFAULT_OFFSET
    start: datetime = field(default_factory=lambda: year_start(DEFAULT_START_YEAR))
    end: datetime = field(default_factory=lambda: year_start(DEFAULT_END_YEAR))
    sample_per_repo: int = DEFAULT_SAMPLE_PER_REPO
    platform: str = PLATFORM
    pinned_orgs: tuple[str, ...] = PINNED_ORGS
    pinned_names: tuple[str, ...] = PINNED_NAMES
    star_types: tuple[str, ...] = STAR_TYPES
    fork_types: tuple[str, ...] = FORK_TYPES
    pr_types: tuple[str, ...] = PR_TYPES
    issue_types: tuple[str, ...] = ISSUE_TYPES
    # event types whose rows carry the newest repository profile
    repo_feature_types: tuple[str, ...] = PR_TYPES
    # event types whose languages/topics describe an actor
    actor_feature_types: tuple[str, ...] = ACTOR_FEATURE_TYPES
    top_languages: int = DEFAULT_TOP_LANGUAGES
    # restrict score rows to one entity type ('Repo'); None keeps every row
    entity_type: str | None = None
    # drop PR/issue events without a number instead of keying them NULL
    drop_null_items: bool = False
    # semi-join key sets with at most this many rows (counted after they are
    # materialised) are broadcast - 4M bigint ids are about 32 MB raw, a hash
    # relation of a few times that, built once on the driver; this covers the
    # union of both samples' actors at the documented production size (about
    # 1.3M each). Bigger sets go through a shuffle join.
    broadcast_max_rows: int = 4_000_000
    # fan-in of the two-round per-repository top-k; None = sqrt(input tasks)
    topk_fan_in: int | None = None
    # global top-N: above this many rows in the final merge ((offset + top_n)
    # x aggregate partitions) a first round per bucket of partitions runs;
    # topn_fan_in forces the bucket count (1 = single round)
    topn_merge_max_rows: int = 2_000_000
    topn_fan_in: int | None = None

    def __post_init__(self) -> None:
        if self.top_n < 0 or self.offset < 0:
            raise ValueError("top_n and offset must be >= 0")
        if self.sample_per_repo < 1:
            raise ValueError("sample_per_repo must be >= 1")
        if not self.start < self.end:
            raise ValueError("window start must be before its end")

    @classmethod
    def for_years(cls, start_year: int, end_year: int, **kw) -> "ExtractConfig":
        """Window ``[start_year-01-01, end_year-01-01)``, i.e. ``start_year <= year < end_year``."""
        return cls(start=year_start(start_year), end=year_start(end_year), **kw)

    def with_(self, **kw) -> "ExtractConfig":
        return replace(self, **kw)
