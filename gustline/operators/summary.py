"""Aggregates: daily extremes with trend, profiles, publication minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.functions.times import day_floor


def daily_summary(df: DataFrame, station: str, ts: str, value: str) -> DataFrame:
    """Maximum, minimum and linear trend (per day) of ``value`` for each station and day.

    Rows without a value are dropped first. The least-squares slope comes from plain sums, which stay
    in generated code and cost less than half of ``regr_slope``. Its x is the fraction of the day from
    noon, at most 0.5 in size, which keeps the sums well conditioned. A single sample has trend 0;
    several samples at one instant have none.
    """
    x = F.timestamp_diff("MICROSECOND", day_floor(ts), ts) / F.lit(86_400_000_000.0) - F.lit(0.5)
    rows = df.na.drop(subset=[value]).select(
        F.col(station).alias("station"), F.to_date(ts).alias("obs_date"), F.col(value).alias("y"), x.alias("x")
    )
    sums = rows.groupBy("station", "obs_date").agg(
        F.max("y").alias("max_value"),
        F.min("y").alias("min_value"),
        F.count("y").alias("n_obs"),
        F.sum("x").alias("_x"),
        F.sum("y").alias("_y"),
        F.sum(F.col("x") * F.col("x")).alias("_xx"),
        F.sum(F.col("x") * F.col("y")).alias("_xy"),
        (F.max("x") > F.min("x")).alias("_spread"),
    )
    n = F.col("n_obs")
    slope = F.try_divide(n * F.col("_xy") - F.col("_x") * F.col("_y"), n * F.col("_xx") - F.col("_x") * F.col("_x"))
    trend = F.when(n == 1, F.lit(0.0)).when(F.col("_spread"), F.round(slope, 4))
    return sums.select("station", "obs_date", "max_value", "min_value", "n_obs", trend.alias("slope"))


def distinct_profile(df: DataFrame, station: str, ts: str) -> DataFrame:
    """Distinct days, months and years per station, each counted from one partial aggregate."""
    days = df.groupBy(F.col(station).alias("station"), F.to_date(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    return days.groupBy("station").agg(
        F.count("_day").alias("n_days"),
        F.count_distinct(F.trunc("_day", "MM")).alias("n_months"),
        F.count_distinct(F.year("_day")).alias("n_years"),
        F.sum("_n").alias("n_rows"),
    )


def profile(df: DataFrame, columns: list[str], quartiles: bool = False) -> DataFrame:
    """Count, mean, deviation and range of numeric columns, one row each, in one pass.

    ``quartiles`` adds approximate 25, 50 and 75 % points, whose sketch stays small on any volume.
    """

    def stats(c: str):
        parts = [
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.round(F.avg(c), 4).alias("mean"),
            F.round(F.stddev_samp(c), 4).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ]
        if quartiles:
            parts.append(F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75]).alias("quartiles"))
        return F.struct(*parts)

    return df.agg(F.array(*[stats(c) for c in columns]).alias("_s")).select(F.inline("_s"))


def publish_minute(changes: DataFrame, collected: str) -> DataFrame:
    """Minute past the hour at which readings first appear, with its share of all first appearances."""
    return changes.groupBy(F.minute(collected).alias("minute")).agg(F.count(F.lit(1)).alias("n_readings"))


def publish_minute_quantiles(changes: DataFrame, collected: str, shares: list[float]) -> DataFrame:
    """Minutes by which the given shares of readings had appeared, from the 60-row histogram."""
    histogram = publish_minute(changes, collected)
    points = F.array(*[F.lit(s) for s in shares])
    return histogram.agg(F.percentile("minute", points, F.col("n_readings")).alias("minutes"))
