"""Projections to the canonical record."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions import text as X
from gustline.functions import times as T
from gustline.functions import units as U
from gustline.schema import DOUBLE_FIELDS, FIELDS, INT_FIELDS

# Text that is the same for every station of the feed.
FEED_CONSTANTS = {
    "credit": "NOAA's National Weather Service",
    "credit_URL": "https://weather.gov/",
    "image": None,
    "suggested_pickup": "15 minutes after the hour",
    "suggested_pickup_period": "60",
    "icon_url_base": "https://forecast.weather.gov/images/wtf/small/",
    "icon_url_name": None,
    "disclaimer_url": "https://www.weather.gov/disclaimer.html",
    "copyright_url": "https://www.weather.gov/disclaimer.html",
    "privacy_policy_url": "https://www.weather.gov/notice.html",
}
HISTORY_URL = "https://www.weather.gov/data/obhistory/"
METAR_URL = "https://www.weather.gov/data/METAR/"


def canonical(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The 43 columns by name and in order; absent ones are NULL. ``keep`` names extra columns to retain."""
    have = set(df.columns)
    fields = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in FIELDS]
    return df.select(*fields, *keep)


def typed(df: DataFrame) -> DataFrame:
    """Text record -> typed record: numbers, ``obs_local`` (wall clock), ``tz_abbr`` and ``obs_ts`` (instant)."""
    casts = {c: U.number(c) for c in (*DOUBLE_FIELDS, "latitude", "longitude")}
    casts |= {c: U.number(F.rtrim(F.col(c), F.lit("%"))).cast("int") for c in INT_FIELDS}
    cleaned = df.withColumn("observation_time", X.strip_update_prefix("observation_time"))
    return cleaned.withColumns(
        {
            **casts,
            "obs_local": T.parse_time("observation_time"),
            "tz_abbr": T.zone_abbreviation("observation_time"),
            "obs_ts": T.parse_rfc_time("observation_time_rfc822"),
        }
    )


def select_positions(df: DataFrame, positions: list[int] = (9, 19, 17, 21, 16)) -> DataFrame:
    """Column subset by position; all columns when a position does not exist."""
    if any(p >= len(df.columns) for p in positions):
        return df
    return df.select(*[df.columns[p] for p in positions])


def with_collection_time(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    return df.withColumn("collection_time", as_of if as_of is not None else F.current_timestamp())


def normalised_names(df: DataFrame) -> DataFrame:
    """Header cells without blanks and quotes, inner blanks as underscores."""
    return df.toDF(*[re.sub(r"\s+", "_", X.column_name(c)) for c in df.columns])


def history_to_observations(history: DataFrame, stations: DataFrame) -> DataFrame:
    """Three-day-history rows (text columns plus Year, Month, station_id) -> canonical record.

    ``stations(station_id, location, latitude, longitude, tz_abbr, offset_minutes)`` gives what the
    history table leaves out, including the zone.
    """
    wind = U.wind_parts("Wind (mph)")
    clock = F.concat_ws(" ", F.concat_ws("-", "Year", "Month", "Date"), F.col("Time"))
    local = T.parse_plain_time(clock)
    joined = history.join(stations, "station_id", "left").withColumns({"_w": wind, "_local": local})
    direction, speed, gust = F.col("_w.direction"), F.col("_w.mph_text"), F.col("_w.gust_text")
    air, dew, chill, heat = (F.col(c) for c in ("Air", "Dwpt", "Wind Chill (°F)", "Heat Index (°F)"))
    derived = {
        "observation_time": F.concat_ws(" ", F.date_format("_local", "MMM d yyyy, h:mm a"), "tz_abbr"),
        "observation_time_rfc822": T.emit_time("_local", "rfc", F.col("offset_minutes")),
        "weather": F.col("Weather"),
        "temperature_string": U.temperature_display(air),
        "temp_f": air,
        "temp_c": U.celsius(U.number(air)),
        "relative_humidity": F.col("Relative Humidity"),
        "wind_string": U.wind_display(direction, speed, gust),
        "wind_dir": direction,
        "wind_degrees": F.col("_w.degrees"),
        "wind_mph": speed,
        "wind_kt": U.knots("_w.mph"),
        "wind_gust_mph": gust,
        "wind_gust_kt": U.knots("_w.gust_mph"),
        "pressure_string": U.pressure_display("sea level (mb)"),
        "pressure_mb": F.col("sea level (mb)"),
        "pressure_in": F.col("altimeter (in)"),
        "dewpoint_string": U.temperature_display(dew),
        "dewpoint_f": dew,
        "dewpoint_c": U.celsius(U.number(dew)),
        "heat_index_string": U.temperature_display(heat, gap=""),
        "heat_index_f": heat,
        "heat_index_c": U.celsius(U.number(heat)),
        "windchill_string": U.temperature_display(chill, gap=""),
        "windchill_f": chill,
        "windchill_c": U.celsius(U.number(chill)),
        "visibility_mi": F.col("`Vis. (mi.)`"),
        "two_day_history_url": F.concat(F.lit(HISTORY_URL), "station_id", F.lit(".html")),
        "ob_url": F.concat(F.lit(METAR_URL), "station_id", F.lit(".1.txt")),
        **{k: F.lit(v) for k, v in FEED_CONSTANTS.items()},
    }
    columns = [derived[c].cast("string").alias(c) if c in derived else F.col(c).cast("string").alias(c) for c in FIELDS]
    return joined.select(*columns)
