"""Gap audit and repair of a periodic series (one reading per station and hour)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.times import day_floor, hour_diff, hour_floor, hours
from gustline.operators.ordered import ROWS_PER_SLICE, ordered

HOURS_PER_DAY = 24
HOURS_PER_YEAR = 366 * HOURS_PER_DAY


def hourly_series(df: DataFrame, station: str, ts: str, tie: str, *measures: str) -> DataFrame:
    """Reduce a feed to its grain: the newest reading of every (station, hour).

    Aggregation is partial before the shuffle, so a hot station costs no more than its hours. After
    this step a station has at most 8,784 rows a year, whatever the feed's volume.
    """
    newest = F.max_by(F.struct(*measures), F.struct(ts, tie)).alias("_m") if measures else F.count(F.lit(1)).alias("_n")
    hourly = df.groupBy(station, hour_floor(ts).alias("obs_hour")).agg(newest)
    return hourly.select(station, "obs_hour", *[F.col("_m")[m].alias(m) for m in measures])


def _prior(previous: Column, ts: Column) -> Column:
    """Time before a row. The first row of a station is measured from one hour before the first reading its day should have:
    hour 0 at the row's own minute."""
    return F.coalesce(previous, day_floor(ts) + (ts - hour_floor(ts)) - hours(1))


def gap_rows(
    df: DataFrame, station: str, ts: str, order: list[str], rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Rows that do not follow their predecessor by 0 or 1 hour.

    Adds ``prev_ts``, ``diff_hours`` and ``n_missing`` (0 for a step backwards or a fraction).
    """
    scan = ordered(df, [station], order, rows_per_slice).previous("_prev", ts)
    diff = hour_diff(ts, "prev_ts")
    missing = F.greatest(F.floor(F.col("diff_hours")).cast("int") - 1, F.lit(0))
    return (
        scan.done()
        .withColumn("prev_ts", _prior(F.col("_prev")[ts], F.col(ts)))
        .withColumn("diff_hours", diff)
        .where((F.col("diff_hours") != 0) & (F.col("diff_hours") != 1))
        .withColumn("n_missing", missing)
        .drop("_prev")
    )


def missing_hours(gaps: DataFrame, station: str, ts: str) -> DataFrame:
    """One row per missing hour of :func:`gap_rows`, under the hour's own date.

    A gap is taken apart into years, days and hours in turn, so that one wrong date of another century never makes one array
    of all its hours.
    """
    last = F.col("n_missing") - 1
    years = gaps.where(F.col("n_missing") > 0).select(
        station, "prev_ts", F.col(ts).alias("next_ts"), "n_missing",
        F.explode(F.sequence(F.lit(0), last, F.lit(HOURS_PER_YEAR))).alias("_year"),
    )
    days = years.withColumn(
        "_day", F.explode(F.sequence(F.col("_year"), F.least(last, F.col("_year") + HOURS_PER_YEAR - 1), F.lit(HOURS_PER_DAY)))
    )
    each = days.withColumn("_hour", F.explode(F.sequence(F.col("_day"), F.least(last, F.col("_day") + HOURS_PER_DAY - 1))))
    missing = (F.col("prev_ts") + hours(F.col("_hour") + 1)).alias("missing_ts")
    return each.select(station, missing, "prev_ts", "next_ts").withColumn("missing_date", F.to_date("missing_ts"))


def backwards_rows(
    df: DataFrame, station: str, ts: str, arrival: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Rows whose time lies before the time of the row that arrived just before them."""
    scan = ordered(df, [station], arrival, rows_per_slice).previous("_prev", ts)
    return scan.done().withColumn("prev_ts", F.col("_prev")[ts]).where(F.col(ts) < F.col("prev_ts")).drop("_prev")


def day_hours(df: DataFrame, station: str, ts: str) -> DataFrame:
    """Per station and day: row count and the hours seen, as a 24-bit mask."""
    bit = F.call_function("shiftleft", F.lit(1), F.hour(ts))
    return df.groupBy(station, F.to_date(ts).alias("obs_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_or(bit).alias("hour_mask")
    )


def day_completeness(df: DataFrame, station: str, ts: str, as_of: Column | None = None) -> DataFrame:
    """Observation and hour counts per day. A day with fewer hours than it should have is short: 24, or on the day of ``as_of``
    the hours up to it."""
    n_hours = F.bit_count("hour_mask").cast("bigint")
    due = F.lit(HOURS_PER_DAY)
    if as_of is not None:
        due = F.when(F.col("obs_date") == F.to_date(as_of), F.hour(as_of) + 1).otherwise(due)
    return day_hours(df, station, ts).select(
        station, "obs_date", "n_rows", n_hours.alias("n_hours"), (n_hours < due).alias("is_short")
    )


def gap_fill(
    hourly: DataFrame, station: str, measures: list[str], constants: list[str] = (), as_of: Column | None = None
) -> DataFrame:
    """Add a row for every hour without one, from a station's first day to its last, up to ``as_of`` if it is given.

    ``hourly`` has one row per station and hour (:func:`hourly_series`). Measures of added rows are NULL, ``constants``
    (location, coordinates) are copied from the station's first row. A day's rows are brought together once, at most 24 of
    them; a window over the days of a station gives the day before, and days without any row are taken apart into years, days
    and hours in turn, so no date error makes one large array.
    """
    values = [*measures, *constants]
    row = F.struct(F.hour("obs_hour").alias("h"), *values)
    days = hourly.groupBy(station, F.to_date("obs_hour").alias("_day")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    in_order = Window.partitionBy(station).orderBy("_day")
    days = days.withColumn("_prev", F.lag("_day").over(in_order))
    first = F.first(F.col("_rows")[0]).over(in_order) if constants else F.lit(None)
    days = days.withColumn("_first", first)
    # the days before this one without a row, and the day itself as the last step: a year at a time, then a day at a time
    n_steps = F.greatest(F.coalesce(F.datediff("_day", "_prev"), F.lit(1)), F.lit(1))
    each = days.withColumn("_n", n_steps).withColumn("_year", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(366))))
    each = each.withColumn("_step", F.explode(F.sequence(F.col("_year"), F.least(F.col("_n"), F.col("_year") + 365))))
    each = each.withColumns({
        "_day": F.date_add("_day", F.col("_step") - F.col("_n")), "_rows": F.when(F.col("_step") == F.col("_n"), F.col("_rows"))
    })
    both = each.select(station, "_day", "_rows", "_first", F.explode(F.sequence(F.lit(0), F.lit(HOURS_PER_DAY - 1))).alias("_h"))
    own = F.get(F.filter("_rows", lambda r: r["h"] == F.col("_h")), F.lit(0))
    both = both.select(station, "_first", (F.col("_day").cast("timestamp_ntz") + hours(F.col("_h"))).alias("obs_hour"), own.alias("_own"))
    if as_of is not None:
        both = both.where(F.col("_own").isNotNull() | (F.col("obs_hour") <= as_of))
    added = F.col("_own").isNull()
    return both.select(
        station, "obs_hour", *[F.col("_own")[m].alias(m) for m in measures],
        *[F.when(added, F.col("_first")[c]).otherwise(F.col("_own")[c]).alias(c) for c in constants],
        added.alias("is_added"),
    )


def retime_repair(
    df: DataFrame,
    station: str,
    ts: str,
    row_id: str,
    measures: list[str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """On days with exactly 24 rows and a gap, move the row before the last gap to its last missing hour.

    The moved row keeps its place and loses its measures. Rows are in the order (ts, row_id), which must be
    unique inside a station. Adds ``is_retimed``.

    One ordered scan: a row sees the gap before it, a day counts its rows and finds its last gap, and the row
    before that gap sees it from there. All windows share the station's shuffle.
    """
    scan = ordered(df, [station], [ts, row_id], rows_per_slice).previous("_prev", ts)
    gap = F.floor(F.coalesce(hour_diff(ts, F.col("_prev")[ts]), F.lit(0.0))).cast("int") - 1
    scan = scan.mark(_gap=gap, _day=F.to_date(ts))
    day = Window.partitionBy(station, "_day")
    here = F.struct(ts, row_id)
    is_last = F.max(F.when(F.col("_gap") >= 1, here)).over(day) == here
    closes = (F.count(F.lit(1)).over(day) == HOURS_PER_DAY) & F.coalesce(is_last, F.lit(False))
    done = scan.mark(_closes=closes).following("_next", "_gap", "_closes").done()
    moved = F.coalesce(F.col("_next._closes"), F.lit(False))
    return (
        done.withColumn("is_retimed", moved)
        .withColumns({m: F.when(~F.col("is_retimed"), F.col(m)) for m in measures})
        .withColumn(ts, F.when(F.col("is_retimed"), F.col(ts) + hours(F.col("_next._gap"))).otherwise(F.col(ts)))
        .drop("_prev", "_gap", "_day", "_closes", "_next")
    )


def audit(
    df: DataFrame, station: str, ts: str, row_id: str, measures: list[str], constants: list[str], as_of: Column | None = None
) -> DataFrame:
    """Whole audit: retime first, then reduce to hours and fill the gaps, up to ``as_of`` if it is given."""
    retimed = retime_repair(df, station, ts, row_id, measures)
    hourly = hourly_series(retimed, station, ts, row_id, *measures, *constants)
    return gap_fill(hourly, station, measures, constants, as_of)


def plateau_flag(
    df: DataFrame, station: str, value: str, order: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Mark rows whose value equals the next value of the station."""
    scan = ordered(df, [station], order, rows_per_slice).following("_next", value)
    same = F.coalesce(F.col("_next")[value] == F.col(value), F.lit(False))
    return scan.done().withColumn("is_plateau", same).drop("_next")


def rollover_segments(
    df: DataFrame,
    station: str,
    ts: str,
    order: list[str],
    every_hours: int = 0,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Number the output segments of a station.

    A new segment starts when the date advances, or when ``every_hours`` is set and the hour of day
    has moved by a non-zero multiple of it since the row before.
    """
    scan = ordered(df, [station], order, rows_per_slice).previous("_prev", ts)
    prior = F.col("_prev")[ts]
    cut = F.to_date(ts) > F.to_date(prior)
    if every_hours > 0:
        moved = F.hour(ts) - F.hour(prior)
        cut = cut | ((moved != 0) & (moved % every_hours == 0))
    scan = scan.mark(_cut=F.coalesce(cut, F.lit(True)).cast("int")).running_sum("segment", F.col("_cut"))
    return scan.done().drop("_prev", "_cut")


def tumbling_segments(df: DataFrame, ts: str, every_hours: int) -> DataFrame:
    """Stateless form of the n-hour cut: the start of the n-hour slot of the day."""
    slot = F.floor(F.hour(ts) / every_hours) * every_hours
    return df.withColumn("segment_start", day_floor(ts) + hours(slot))

