"""Predicates on single readings and the filters built from them."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("observation_time", "wind_mph", "wind_dir", "wind_string")
DERIVED_FILES = "Range|Month|Year|latest|dupcheck"


def is_suspect(columns=REQUIRED) -> Column:
    """True when any required value is missing."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def sanity_split(df: DataFrame, columns=REQUIRED) -> tuple[DataFrame, DataFrame]:
    """All rows with an ``is_suspect`` flag, and the flagged rows for quarantine."""
    flagged = df.withColumn("is_suspect", is_suspect(columns))
    return flagged, flagged.where("is_suspect")


def is_current(obs: Column, local_now: Column) -> Column:
    """Reading of the local day, or of hour 23 (published after midnight)."""
    return (F.to_date(obs) == F.to_date(local_now)) | (F.hour(obs) == 23)


def not_before_batch(obs: Column, batch_date: Column) -> Column:
    """Late-data rule: not older than the date of the file being written."""
    return F.to_date(obs) >= batch_date


def is_derived_file(name: Column | str) -> Column:
    """Combined, latest and check copies, which are never read as base data."""
    name = F.col(name) if isinstance(name, str) else name
    return name.rlike(DERIVED_FILES)


def original_files(df: DataFrame, name: str) -> DataFrame:
    return df.where(~is_derived_file(name))


def date_range(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Rows of the days ``start`` to ``end``, both included, as a range on the stored column.

    Comparing the column itself (not its date) lets the predicate reach the file scan.
    """
    first = F.to_date(start).cast("timestamp_ntz")
    after = F.date_add(F.to_date(end), 1).cast("timestamp_ntz")
    return df.where((F.col(ts) >= first) & (F.col(ts) < after))


def period(df: DataFrame, ts: str, year: int, month: int | None = None, day: int | None = None) -> DataFrame:
    """Rows of one year, month or day, as a range on the stored column."""
    first = date(year, month or 1, day or 1)
    if day:
        last = first
    elif month:
        last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    else:
        last = date(year, 12, 31)
    return date_range(df, ts, F.lit(first), F.lit(last))


def coming_hours(df: DataFrame, ts: str, as_of: Column, hours: int = 72) -> DataFrame:
    """Rolling slice from the as-of day to ``hours`` later, whole days."""
    return date_range(df, ts, as_of, F.date_add(F.to_date(as_of), hours // 24))
