"""Newest, nth and as-of rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.times import date_of_file
from gustline.operators.ordered import ROWS_PER_SLICE, ordered

# Spark cuts a task's rows to n per key before the shuffle up to this n.
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by partial aggregation: no window, no hot task."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def nth_row(
    df: DataFrame, keys: list[str], order: list[str], n: int, newest_first: bool = False, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """The ``n``-th row (1-based) per key in ``order``, or from its end. ``order`` must be total inside a key.

    A small ``n`` lets Spark cut every task to ``n`` rows per key before the shuffle. Beyond that limit a running count of
    the ordered scan numbers the rows, which splits hot keys.
    """
    if n <= int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING, "1000")):
        by = [F.desc(c) for c in order] if newest_first else order
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        return df.withColumn("_place", place).where(F.col("_place") == n).drop("_place")
    return numbered_row(df, keys, order, n, newest_first, rows_per_slice)


def numbered_row(
    df: DataFrame, keys: list[str], order: list[str], n: int, newest_first: bool = False, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """:func:`nth_row` for any ``n`` by a running count."""
    numbered = ordered(df, keys, order, rows_per_slice).running_sum("_place", F.lit(1)).done()
    if not newest_first:
        return numbered.where(F.col("_place") == n).drop("_place")
    ends = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    ends = ends.withColumnsRenamed({k: "_end_" + k for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & numbered[k].eqNullSafe(ends["_end_" + k])
    found = numbered.join(ends, same & (F.col("_place") == F.col("_n") - n + 1))
    return found.drop("_place", "_n", *["_end_" + k for k in keys])


def asof_latest(df: DataFrame, key: str, ts: str, tie: str, columns: list[str], as_of: Column) -> DataFrame:
    """Newest row per key not later than one day after ``as_of`` (stations ahead of the clock count)."""
    usable = df.where(F.col(ts) < F.date_add(F.to_date(as_of), 2).cast("timestamp_ntz"))
    return latest_per_key(usable, [key], [ts, tie], columns)


def best_source(df: DataFrame, keys: list[str], priority: str, arrival: str, columns: list[str]) -> DataFrame:
    """One row per key: lowest ``priority`` first, then earliest ``arrival``."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(priority, arrival)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def newest_file(files: DataFrame, name: str, as_of: Column) -> DataFrame:
    """Newest daily file per station of the as-of month that is not from a later day; copies are ignored."""
    day = F.to_date(as_of)
    dated = (
        files.where(~F.col(name).rlike("latest|dupcheck"))
        .withColumn("_day", date_of_file(name))
        .where((F.trunc("_day", "MM") == F.trunc(day, "MM")) & (F.col("_day") <= day))
        .withColumn("station", F.regexp_extract(name, r"^(.*?)_Y\d{4}_", 1))
    )
    return dated.groupBy("station").agg(F.max(name).alias(name))
