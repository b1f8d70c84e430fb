"""Readers for the two logical inputs.

``rank_scores``: repo_id, repo_name, org_login, platform, type, openrank, created_at
``activity``:    event_id, actor_id, repo_id, repo_name, created_at, platform, type,
                 issue_number, repo_language, repo_topics, repo_description

Both readers only rename and retype columns; nothing is materialised, so
Catalyst still prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import YEAR_COLUMN

SCORE_COLUMNS = ("repo_id", "repo_name", "org_login", "platform", "type", "openrank", "created_at")
ACTIVITY_COLUMNS = ("event_id", "actor_id", "repo_id", "repo_name", "created_at", "platform", "type",
                    "issue_number", "repo_language", "repo_topics", "repo_description")


def _topics_column(df: DataFrame) -> F.Column | None:
    """The topic names as ``array<string>`` whatever shape the source uses.

    Accepted shapes: ``repo_topics array<string>``; ``repo_topics
    array<struct<name: string>>`` or ``struct<name: array<string>>`` (nested
    field, read as ``repo_topics.name``); a flat column literally named
    ``repo_topics.name``; a JSON-text string (CSV and other text sources).
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    if "repo_topics.name" in fields:
        return F.col("`repo_topics.name`")
    dt = fields.get("repo_topics")
    if dt is None:
        return None
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
        return F.col("repo_topics.name")
    if isinstance(dt, T.StructType) and "name" in dt.fieldNames():
        return F.col("repo_topics.name")
    if isinstance(dt, T.StringType):  # text formats: a JSON array such as ["db","web"]
        return F.from_json(F.col("repo_topics"), T.ArrayType(T.StringType()))
    return F.col("repo_topics")


def normalise_activity(df: DataFrame) -> DataFrame:
    """Project a raw event table onto the ``activity`` schema."""
    topics = _topics_column(df)
    cols = []
    for name in ACTIVITY_COLUMNS:
        if name == "repo_topics":
            c = topics if topics is not None else F.lit(None).cast("array<string>")
            cols.append(c.cast("array<string>").alias(name))
        elif name in df.columns:
            cols.append(F.col(name))
        elif name == "event_id":
            raise ValueError("activity needs an event_id column (the sample's tie-break)")
        else:
            cols.append(F.lit(None).alias(name))
    # the year folders of a stored table stay, so that a window prunes them
    year = [F.col(YEAR_COLUMN)] if YEAR_COLUMN in df.columns else []
    out = df.select(*cols, *year)
    return out.select(
        F.col("event_id").cast("bigint"),
        F.col("actor_id").cast("bigint"),
        F.col("repo_id").cast("bigint"),
        F.col("repo_name").cast("string"),
        F.col("created_at").cast("timestamp_ntz"),
        F.col("platform").cast("string"),
        F.col("type").cast("string"),
        F.col("issue_number").cast("bigint"),
        F.col("repo_language").cast("string"),
        F.col("repo_topics"),
        F.col("repo_description").cast("string"),
        *year,
    )


def normalise_scores(df: DataFrame) -> DataFrame:
    """Project a raw score table onto the ``rank_scores`` schema."""
    return df.select(
        F.col("repo_id").cast("bigint"),
        F.col("repo_name").cast("string"),
        F.col("org_login").cast("string"),
        F.col("platform").cast("string"),
        F.col("type").cast("string"),
        F.col("openrank").cast("double"),
        F.col("created_at").cast("timestamp_ntz"),
    )


def read_activity(spark: SparkSession, path_or_table: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read the event log from a path (parquet/orc/json/csv…, reader ``options``) or a catalog table."""
    if fmt == "table":
        return normalise_activity(spark.table(path_or_table))
    return normalise_activity(spark.read.format(fmt).options(**options).load(path_or_table))


def read_scores(spark: SparkSession, path_or_table: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read the score history from a path (reader ``options``) or a catalog table."""
    if fmt == "table":
        return normalise_scores(spark.table(path_or_table))
    return normalise_scores(spark.read.format(fmt).options(**options).load(path_or_table))


#: Columns of single look-ups (one actor's history, one repository's newest profile); no folder or sort order serves them.
LOOKUP_COLUMNS = ("actor_id", "repo_name")


def bloom_options(columns, max_bytes: int) -> dict[str, str]:
    """Parquet writer options for a Bloom filter per row group on each of ``columns``.

    The writer fits the filter's size to the values that a row group holds (at
    most ``max_bytes``); where a row group's dictionary lists its values, readers
    use that instead, and no filter is stored.
    """
    options = {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(max_bytes)}
    return options | {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


def write_activity(act: DataFrame, path: str, num_partitions: int | None = None,
                   mode: str = "error", lookup_columns=LOOKUP_COLUMNS, bloom_max_bytes: int = 1 << 20,
                   row_group_bytes: int | None = None, **options) -> None:
    """Store the activity log in the layout the extraction reads fastest.

    Folders are ``platform`` / ``event_year`` / ``type``: every operator filters on
    platform and type, and the in-window ones on the years of the window
    (``windowed_rows`` adds that folder condition to the time range), so a scan
    lists only the folders it needs. Rows are range-partitioned on these
    columns, repository and time before the write, so a hot event type is
    spread over many tasks instead of one, and a file holds a narrow range of
    repositories, which row-group statistics can skip on. Pick
    ``num_partitions`` near the data size over the target file size (e.g.
    100 TB / 1 GB = 100k); the default is the session's shuffle partition count.

    The folders and the order don't help a look-up by actor or repository name,
    whose rows lie anywhere in its folders. Row groups therefore carry Bloom
    filters on ``lookup_columns``: an equality on one of them is pushed into the
    scan, which then reads only the row groups that may hold the value, at the
    cost of at most ``bloom_max_bytes`` a column and row group. Smaller
    ``row_group_bytes`` (default: Parquet's 128 MB) make a look-up read less and
    the filters and footers larger. ``options`` go to the writer.
    """
    spark = act.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = bloom_options(lookup_columns, bloom_max_bytes)
    if row_group_bytes:
        extra["parquet.block.size"] = str(row_group_bytes)
    extra |= options
    folders = ["platform", YEAR_COLUMN, "type"]
    keys = [*folders, "repo_id", "created_at"]
    (normalise_activity(act).withColumn(YEAR_COLUMN, F.year("created_at"))
     .repartitionByRange(n, *keys)
     .sortWithinPartitions(*keys)
     .write.mode(mode)
     .options(**extra)
     .partitionBy(*folders)
     .parquet(path))


def register_inputs(scores: DataFrame, act: DataFrame, scores_view: str = "rank_scores",
                    activity_view: str = "activity") -> None:
    """Expose the two inputs to Spark SQL as temporary views (session scoped).

    ``spark.sql`` over these views is planned by the same optimizer as the
    DataFrame operators; the default names avoid clashing with a raw
    ``events`` table.
    """
    scores.createOrReplaceTempView(scores_view)
    act.createOrReplaceTempView(activity_view)


def write_scores(scores: DataFrame, path: str, num_partitions: int | None = None,
                 mode: str = "error") -> None:
    """Store the score history partitioned by ``platform`` and clustered on time.

    Range partitioning on (platform, created_at, repo_id) before the write
    gives every file a narrow time range, so the window predicate skips whole
    files and row groups; the platform equality prunes folders.
    """
    spark = scores.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["platform", "created_at", "repo_id"]
    (normalise_scores(scores)
     .repartitionByRange(n, *keys)
     .sortWithinPartitions(*keys)
     .write.mode(mode)
     .partitionBy("platform")
     .parquet(path))
