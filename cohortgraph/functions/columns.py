"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ITEM_KEY_SEPARATOR, YEAR_COLUMN


def ts_literal(value: datetime) -> Column:
    """A ``timestamp_ntz`` literal built from its ISO text.

    Going through a string keeps the value independent of the Python and
    session time zones (a ``datetime`` literal is first read as a zoned
    timestamp).
    """
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def in_window(col: str | Column, start: datetime, end: datetime) -> Column:
    """Half-open time window ``start <= col < end``.

    Written as a range on the raw column rather than ``year(col)`` so both
    bounds reach the parquet scan as pushed filters (row-group skipping);
    ``year(col) >= y`` is not pushed down.
    """
    c = F.col(col) if isinstance(col, str) else col
    return (c >= ts_literal(start)) & (c < ts_literal(end))


def windowed_rows(df: DataFrame, start: datetime, end: datetime) -> Column:
    """``in_window`` on ``created_at``, and on the year folders of a stored table (``YEAR_COLUMN``).

    The folder condition follows from the range, so it only prunes.
    """
    cond = in_window("created_at", start, end)
    if YEAR_COLUMN in df.columns:
        last = end.year if (end.month, end.day, end.time()) != (1, 1, time()) else end.year - 1
        cond = cond & F.col(YEAR_COLUMN).between(start.year, last)
    return cond


def item_key(repo_id: str = "repo_id", number: str = "issue_number") -> Column:
    """Pull-request / issue key ``<repo_id>#<number>``.

    ``concat`` (not ``concat_ws``) so a missing number gives a NULL key, as a
    string concatenation with a NULL operand does in SQL.
    """
    return F.concat(F.col(repo_id).cast("string"), F.lit(ITEM_KEY_SEPARATOR), F.col(number).cast("string"))


def non_blank(col: str) -> Column:
    """Non-empty string (NULL is dropped as well)."""
    return F.col(col) != F.lit("")


def non_empty(col: str) -> Column:
    """Array with at least one element (NULL is dropped as well)."""
    return F.size(F.col(col)) > 0


def render_arrays(df, *names: str):
    """Arrays as JSON text (the form used for CSV cells and result hashing)."""
    out = df
    for n in names:
        out = out.withColumn(n, F.to_json(F.col(n)))
    return out
