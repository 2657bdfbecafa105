"""Small landed formats: tide predictions, tracker CSV, station lists, zone table, forecast blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.functions.text import station_of_url
from gustline.functions.times import utc_offset_minutes
from gustline.functions.units import number
from gustline.operators.project import normalised_names
from gustline.sources.observations import named_files

TIDE_LINE = r"^\s*\d{4}/\d{2}/\d{2}\s"
ZONE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("abbr", "name", "utc_offset")])


def tide_table(lines: DataFrame, line: str, keep: list[str] = ()) -> DataFrame:
    """Text lines -> typed tide predictions; preamble and header lines are dropped by shape."""
    part = F.split(F.trim(line), r"\s+")
    return lines.where(F.col(line).rlike(TIDE_LINE)).select(
        *keep,
        F.try_to_date(part[0], "yyyy/MM/dd").alias("date"),
        F.get(part, F.lit(1)).alias("day"),
        F.get(part, F.lit(2)).alias("time"),
        F.get(part, F.lit(3)).alias("ampm"),
        number(F.get(part, F.lit(4))).alias("pred_ft"),
        number(F.get(part, F.lit(5))).alias("pred_cm"),
        F.get(part, F.lit(6)).alias("high_low"),
        F.concat_ws(" ", F.get(part, F.lit(2)), F.get(part, F.lit(3))).alias("tide_time"),
    )


def read_tides(spark: SparkSession, *paths: str) -> DataFrame:
    """Tide predictions of one or more files, such as two years."""
    return tide_table(spark.read.text(list(paths)), "value")


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Five-minute tracker CSV: columns named by its header line, all text."""
    return normalised_names(spark.read.option("header", True).option("multiLine", True).csv(path))


def read_station_list(spark: SparkSession, path: str) -> DataFrame:
    """Station URLs, one per line of any length -> station dimension."""
    url = F.trim("value")
    return spark.read.text(path).where(url != "").select(url.alias("url"), station_of_url(url).alias("station_id"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("state")).where("state <> ''")


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone table -> abbreviation, name, offset text, offset in minutes, file position.

    A two-valued offset (standard/daylight) is ambiguous and gives NULL.
    """
    rows = spark.read.schema(ZONE_SCHEMA).option("header", True).option("encoding", "ISO-8859-1").csv(path)
    place = F.monotonically_increasing_id().alias("line_no")
    return rows.select("*", utc_offset_minutes("utc_offset").alias("offset_minutes"), place)


def read_blobs(spark: SparkSession, folder: str, glob: str, by_folder: bool = False) -> DataFrame:
    """Files with their MD5, chosen by name (see :func:`named_files`); ``latest`` copies are left out."""
    files = named_files(spark, folder, glob, by_folder).where(~F.col("file_name").contains("latest"))
    station = F.regexp_extract("file_name", r"^(.*?)_Y\d{4}_", 1)
    return files.select("file_name", station.alias("station"), F.md5("content").alias("md5"), "length")
