"""Record layouts of the station feeds."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the canonical record, in file order.
FIELDS = (
    "credit", "credit_URL", "image", "suggested_pickup", "suggested_pickup_period", "location", "station_id",
    "latitude", "longitude", "observation_time", "observation_time_rfc822", "weather", "temperature_string",
    "temp_f", "temp_c", "relative_humidity", "wind_string", "wind_dir", "wind_degrees", "wind_mph", "wind_kt",
    "wind_gust_mph", "wind_gust_kt", "pressure_string", "pressure_mb", "pressure_in", "dewpoint_string",
    "dewpoint_f", "dewpoint_c", "heat_index_string", "heat_index_f", "heat_index_c", "windchill_string",
    "windchill_f", "windchill_c", "visibility_mi", "icon_url_base", "two_day_history_url", "icon_url_name",
    "ob_url", "disclaimer_url", "copyright_url", "privacy_policy_url",
)

DOUBLE_FIELDS = (
    "temp_f", "temp_c", "wind_mph", "wind_kt", "wind_gust_mph", "wind_gust_kt", "pressure_mb", "pressure_in",
    "dewpoint_f", "dewpoint_c", "heat_index_f", "heat_index_c", "windchill_f", "windchill_c", "visibility_mi",
)

INT_FIELDS = ("relative_humidity", "wind_degrees")

# Column names of the three-day history table, in page order.
HISTORY_FIELDS = (
    "Date", "Time", "Wind (mph)", "Vis. (mi.)", "Weather", "Sky Cond.", "Air", "Dwpt", "Max.", "Min.",
    "Relative Humidity", "Wind Chill (°F)", "Heat Index (°F)", "altimeter (in)", "sea level (mb)",
    "1 hr", "3 hr", "6 hr",
)

RAW_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS])
CORRUPT = "_corrupt_record"
RAW_WITH_CORRUPT = T.StructType([*RAW_RECORD.fields, T.StructField(CORRUPT, T.StringType())])
