"""Profiles from stored sketches: one small row per station and day, merged to months and ranges without reading rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size of a quantile sketch: ranks are off by some 0.1 % of the rows at most, and exact up to this many values.
QUANTILE_SIZE = 2_048
# Size of a distinct sketch as a power of two: the standard error is about 0.8 % at 14 (1.04 / sqrt(2 ** 14)).
DISTINCT_LOG_SIZE = 14


def daily_sketches(df: DataFrame, station: str, ts: str, value: str) -> DataFrame:
    """``station, obs_date, n_rows, n_values, total, min_value, max_value, quantiles, distincts`` per station and day.

    The last two are sketches in Spark's own format, some KB each whatever the number of rows. A row without a time belongs to the day
    NULL; a day without values has NULL sketches.
    """
    day = df.groupBy(F.col(station).alias("station"), F.to_date(ts).alias("obs_date"))
    return day.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_values"),
        F.sum(value).alias("total"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_SIZE)).alias("quantiles"),
        F.hll_sketch_agg(F.col(value).cast("string"), F.lit(DISTINCT_LOG_SIZE)).alias("distincts"),
    )


def merged_sketches(days: DataFrame, *keys) -> DataFrame:
    """Sketches of several days as one per ``keys``, which can be merged further; a partial aggregate."""
    return days.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        F.sum("total").alias("total"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.kll_merge_agg_double("quantiles", F.lit(QUANTILE_SIZE)).alias("quantiles"),
        F.hll_union_agg("distincts").alias("distincts"),
    )


def sketch_profile(merged: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The figures of merged sketches: counts, mean, range, the quantiles in ``shares`` (name -> share) and distinct values.

    A key without values has NULL quantiles and mean, and 0 distinct values.
    """
    known = F.col("n_values") > 0
    sketch = F.when(known, F.col("quantiles"))
    numbers = ("n_rows", "n_values", "total", "min_value", "max_value", "quantiles", "distincts")
    keys = [c for c in merged.columns if c not in numbers]
    quantiles = [F.kll_sketch_get_quantile_double(sketch, F.lit(share)).alias(name) for name, share in shares.items()]
    distinct = F.when(known, F.hll_sketch_estimate("distincts")).otherwise(F.lit(0).cast("bigint"))
    mean = F.try_divide("total", "n_values")
    return merged.select(*keys, "n_rows", "n_values", mean.alias("mean_value"), "min_value", "max_value", *quantiles, distinct.alias("n_distinct"))


def range_profile(days: DataFrame, start, end, shares: dict[str, float]) -> DataFrame:
    """Profile per station of the days from ``start`` to ``end``, and per station and month of them: ``period`` is ``range`` or ``2024-01``."""
    inside = days.where(F.col("obs_date").between(start, end))
    months = merged_sketches(inside, "station", F.date_format("obs_date", "yyyy-MM").alias("period"))
    whole = merged_sketches(months, "station", F.lit("range").alias("period"))
    return sketch_profile(months.unionByName(whole), shares)
