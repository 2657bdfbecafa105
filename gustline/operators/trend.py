"""Polynomial trends of any order from sums that can be stored and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pivot below this share of its diagonal sum means that the times do not determine the polynomial.
SINGULAR = 1e-10


def _power(x: Column, k: int) -> Column:
    made = F.lit(1.0)
    for _ in range(k):
        made = made * x
    return made


def moments(df: DataFrame, keys: list[str], x: Column, y: Column, order: int) -> DataFrame:
    """Per key ``n``, ``xs`` (sums of x ** 0 to x ** (2 * order)) and ``xys`` (sums of y * x ** 0 to y * x ** order).

    ``x`` should be centred and of size one or so, such as a share of the day from noon. Rows without x or y are left out. Sums of
    parts add up to those of the whole (:func:`merged_moments`), so they can be stored per day and merged to any range.
    """
    rows = df.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y")).where("_x is not null and _y is not null")
    x, y = F.col("_x"), F.col("_y")
    return rows.groupBy(*keys).agg(
        F.count("_x").alias("n"),
        F.array(*[F.sum(_power(x, k)) for k in range(2 * order + 1)]).alias("xs"),
        F.array(*[F.sum(y * _power(x, k)) for k in range(order + 1)]).alias("xys"),
    )


def merged_moments(parts: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Sums of several parts of the same key. All parts must have the same centre of x."""
    total = lambda name, size: F.array(*[F.sum(F.get(name, F.lit(k))) for k in range(size)]).alias(name)
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), total("xs", 2 * order + 1), total("xys", order + 1))


def coefficients(xs: Column, xys: Column, order: int) -> Column:
    """Coefficients of the least-squares polynomial, constant first; NULL if the data do not determine it.

    The normal equations are solved by elimination on an array of rows. Their matrix is positive definite, so pivots need no search.
    """
    size = order + 1
    matrix = F.array(*[F.array(*[F.get(xs, F.lit(i + j)) for j in range(size)], F.get(xys, F.lit(i))) for i in range(size)])

    def eliminated(rows: Column, k: Column) -> Column:
        pivot = F.get(F.get(rows, k), k)
        sound = F.abs(pivot) > F.lit(SINGULAR) * F.get(xs, 2 * k)

        def reduced(row: Column, i: Column) -> Column:
            scaled = F.transform(F.get(rows, k), lambda v: v / F.when(sound, pivot))
            other = F.transform(row, lambda v, j: v - F.get(row, k) * F.get(F.get(rows, k), j) / F.when(sound, pivot))
            return F.when(i == k, scaled).otherwise(other)

        return F.transform(rows, reduced)

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(order)), matrix, eliminated)
    found = F.transform(solved, lambda row: F.get(row, F.lit(size)))
    return F.when(~F.exists(found, lambda v: v.isNull()), found)


def slope_at(found: Column, order: int, at: float) -> Column:
    """Slope of the polynomial at ``x = at``: its linear coefficient when x is counted from there."""
    slope = F.lit(0.0)
    for k in range(order, 0, -1):
        slope = slope * F.lit(float(at)) + F.lit(float(k)) * F.get(found, F.lit(k))
    return slope


def daily_moments(df: DataFrame, station: str, ts: str, value: str, order: int) -> DataFrame:
    """:func:`moments` per ``station, obs_date``, with x the share of the day from noon."""
    x = F.timestamp_diff("MICROSECOND", F.to_date(ts).cast("timestamp_ntz"), F.col(ts)) / F.lit(86_400_000_000.0) - F.lit(0.5)
    rows = df.select(F.col(station).alias("station"), F.to_date(ts).alias("obs_date"), x.alias("x"), F.col(value).alias("y"))
    return moments(rows, ["station", "obs_date"], F.col("x"), F.col("y"), order)


def daily_trend(df: DataFrame, station: str, ts: str, value: str, order: int = 1) -> DataFrame:
    """Per station and day the trend of ``value`` of any order: the linear coefficient per day, counted from midnight.

    A day whose distinct times are not more than ``order`` has no trend.
    """
    sums = daily_moments(df, station, ts, value, order)
    found = sums.withColumn("_c", coefficients(F.col("xs"), F.col("xys"), order))
    return found.select("station", "obs_date", F.col("n").alias("n_obs"), slope_at(F.col("_c"), order, -0.5).alias("slope"))
