"""Joins: zone lookup, station enrichment, fallback source, freshness.

No side is forced to broadcast: Spark's own size check (``autoBroadcastJoinThreshold`` and the
adaptive run-time statistics) decides, and a side that outgrows it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.operators.latest import best_source, latest_per_key
from gustline.operators.quality import date_range

# Abbreviations the operating system's zone table knows, minutes east of UTC.
SYSTEM_ZONES = (
    ("EST", -300), ("MST", -420), ("HST", -600), ("UTC", 0), ("GMT", 0), ("WET", 0), ("CET", 60), ("MET", 60),
    ("EET", 120),
)

# Zones of US stations, preferred where an abbreviation has several meanings.
US_ZONES = (
    ("EDT", -240), ("CST", -360), ("CDT", -300), ("MDT", -360), ("PST", -480), ("PDT", -420),
    ("AKST", -540), ("AKDT", -480), ("HDT", -540), ("SST", -660), ("CHST", 600), ("AST", -240), ("ADT", -180),
)


def _zone_map(pairs) -> Column:
    return F.create_map(*[x for abbr, minutes in pairs for x in (F.lit(abbr), F.lit(minutes))])


def zone_lookup(df: DataFrame, abbr: str, zones: DataFrame, preferred=US_ZONES) -> DataFrame:
    """Add ``offset_minutes`` for a zone abbreviation.

    System zones win, then ``preferred``, then the first table row whose abbreviation starts with the
    key. The table (``abbr, offset_minutes, line_no``) is expanded to prefixes, so the match is an
    equi-join on a small dimension.
    """
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length("abbr")), lambda n: F.substring("abbr", F.lit(1), n)))
    first = (
        zones.select(prefix.alias("_abbr"), "offset_minutes", "line_no")
        .groupBy("_abbr")
        .agg(F.min_by("offset_minutes", "line_no").alias("_offset"))
    )
    key = F.upper(F.trim(abbr))
    usable = F.when(~key.rlike(r"^(AM|PM|\d*)$"), key)
    direct = F.try_element_at(_zone_map(SYSTEM_ZONES + tuple(preferred)), "_key")
    return (
        df.withColumn("_key", usable)
        .join(first, F.col("_key") == F.col("_abbr"), "left")
        .withColumn("offset_minutes", F.coalesce(direct, F.col("_offset")))
        .drop("_key", "_abbr", "_offset")
    )


def enrich_stations(
    stations: DataFrame, observations: DataFrame, key: str, order: list[str], columns: list[str]
) -> DataFrame:
    """Left join of every station with its newest observation; a station without one keeps NULLs."""
    return stations.join(latest_per_key(observations, [key], order, columns), key, "left")


def source_fallback(
    primary: DataFrame, alternate: DataFrame, keys: list[str], arrival: str, columns: list[str]
) -> DataFrame:
    """Primary reading per key, the alternate where the primary has none."""
    both = primary.withColumn("priority", F.lit(0)).unionByName(alternate.withColumn("priority", F.lit(1)))
    return best_source(both, keys, "priority", arrival, [*columns, "priority"])


def fresh_keys(df: DataFrame, files: DataFrame, key: str, day: str, as_of: Column, days: int = 7) -> DataFrame:
    """Rows of ``df`` whose key has a file dated within ``days`` before ``as_of``."""
    recent = date_range(files, day, F.date_sub(F.to_date(as_of), days), as_of)
    return df.join(recent.select(key).distinct(), key, "left_semi")
