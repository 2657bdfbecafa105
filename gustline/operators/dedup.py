"""Duplicate handling: high-water accept, change-only rows, fingerprint duplicates, unchanged content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.operators.ordered import ROWS_PER_SLICE, ordered
from gustline.session import reliable_checkpoint


def highwater_accept(
    df: DataFrame,
    station: str,
    ts: str,
    arrival: list[str],
    ignore_dup: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Keep a reading only if it is strictly newer than everything that arrived before it."""
    if ignore_dup:
        return df
    scan = ordered(df, [station], arrival, rows_per_slice).running_max("_high", F.col(ts), inclusive=False)
    return scan.done().where(F.col("_high").isNull() | (F.col(ts) > F.col("_high"))).drop("_high")


def change_only(
    df: DataFrame, station: str, key: str, order: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Rows whose ``key`` differs from the row before; the first row of a station starts no change."""
    scan = ordered(df, [station], order, rows_per_slice).previous("_prev", key)
    changed = F.col("_prev").isNotNull() & ~F.col(key).eqNullSafe(F.col("_prev")[key])
    return scan.done().where(changed).drop("_prev")


def fingerprint_table(df: DataFrame, content: str, *columns: str) -> DataFrame:
    """The given columns with ``content_md5``, checkpointed.

    The rules below read their input more than once. Contents are read and hashed once here, and the
    rules then work on rows of a few dozen bytes.
    """
    return reliable_checkpoint(df.select(*columns, F.md5(content).alias("content_md5")))


def consecutive_flags(
    df: DataFrame, station: str, content: str, order: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Add ``is_dup``: ``content`` (a fingerprint) equals that of the row before in the given order."""
    scan = ordered(df, [station], order, rows_per_slice).previous("_prev", content)
    same = F.coalesce(F.col(content) == F.col("_prev")[content], F.lit(False))
    return scan.done().withColumn("is_dup", same).drop("_prev")


def consecutive_duplicates(
    df: DataFrame, station: str, content: str, order: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Only the rows that repeat the row before them."""
    return consecutive_flags(df, station, content, order, rows_per_slice).where("is_dup").drop("is_dup")


def any_duplicates(df: DataFrame, content: str, row_id: str) -> DataFrame:
    """Rows whose ``content`` occurred under a smaller ``row_id``; adds ``first_id``.

    The first row per content is a partial aggregate, and the join back is one row against many, so a
    huge group of copies is never brought together (adaptive skew join may split it freely).
    """
    first = df.groupBy(content).agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("_n"))
    return df.join(first.where(F.col("_n") > 1).drop("_n"), content).where(F.col(row_id) > F.col("first_id"))


def duplicate_summary(df: DataFrame, group: str, is_dup: Column) -> DataFrame:
    """Files seen and duplicates found per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(is_dup.cast("bigint")), F.lit(0)).alias("n_duplicates")
    )


def skip_unchanged(incoming: DataFrame, stored: DataFrame, station: str, day: str, content: str, ts: str) -> DataFrame:
    """Drop incoming content equal to the newest stored content of its day, else of the day before.

    ``stored`` is reduced to the newest content per (station, day) before it is joined. Contents are
    hashed where they are read, so only fingerprints travel; of equal times the larger fingerprint counts.
    """
    hashed = stored.select(station, day, ts, F.md5(content).alias("_md5"))
    newest = hashed.groupBy(station, day).agg(F.max_by("_md5", F.struct(ts, "_md5")).alias("_md5"))
    # stored content speaks for its own day first, then for the day after
    own = F.struct(F.col(day).alias("d"), F.lit(0).alias("age"))
    next_day = F.struct(F.date_add(day, 1).alias("d"), F.lit(1).alias("age"))
    valid = F.explode(F.array(own, next_day))
    known = (
        newest.select(station, "_md5", valid.alias("_v"))
        .groupBy(station, F.col("_v.d").alias(day))
        .agg(F.min_by("_md5", "_v.age").alias("_md5"))
    )
    # the fingerprint is part of the join key: equal content meets in one row per (station, day)
    return (
        incoming.withColumn("_md5", F.md5(content)).join(known, [station, day, "_md5"], "left_anti").drop("_md5")
    )

