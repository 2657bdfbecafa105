"""Zones with daylight rules: spans of constant offset, and range joins of wall clocks and instants with them.

A zone's rules are a table of transitions, worked out by Spark's own zone functions for the years asked for. Wall clocks are cut into
segments that do not overlap: plain ones, hours that occur twice (the clock goes back) and hours that never occur (it goes forward). So
every wall clock meets one segment, by an equi-join on zone and bin and a comparison inside the bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.functions.times import wall_clock, wall_micros
from gustline.operators.lookups import zone_lookup

# Regions behind abbreviations that stand for both standard and daylight time.
REGIONS = (
    ("ET", "America/New_York"), ("CT", "America/Chicago"), ("MT", "America/Denver"), ("PT", "America/Los_Angeles"),
    ("AKT", "America/Anchorage"), ("AET", "Australia/Sydney"),
)

DAY, MINUTE = 86_400_000_000, 60_000_000
# Width of a bin of the range join; a plain segment of half a year lies in some seven bins.
BIN = 30 * DAY
# Rules change on full quarters of an hour.
STEP = 15 * MINUTE


def _offset(zone: Column, micros: Column) -> Column:
    """Minutes east of UTC in ``zone`` at an instant."""
    at = F.timestamp_micros(micros)
    return ((F.unix_micros(F.from_utc_timestamp(at, zone)) - micros) / MINUTE).cast("int")


def regions(spark: SparkSession, pairs=REGIONS) -> DataFrame:
    """``abbr, zone``: the two-valued abbreviations with their regions."""
    return spark.createDataFrame(list(pairs), "abbr string, zone string")


def zone_transitions(zones: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """``zone, at, before, after``: instants (epoch micros) at which the offset of a zone changes, with both offsets in minutes.

    Each day is looked at once and a day with a change quarter by quarter, so a zone costs 365 rows a year and no sort.
    """
    start, end = (F.unix_micros(F.to_timestamp(F.lit(f"{year}-01-01 00:00:00Z"))) for year in (first_year, last_year + 1))
    days = zones.select("zone").distinct().select("zone", F.explode(F.sequence(start, end - DAY, F.lit(DAY))).alias("day"))
    changed = days.where(_offset(F.col("zone"), F.col("day")) != _offset(F.col("zone"), F.col("day") + DAY))
    steps = F.sequence(F.col("day") + STEP, F.col("day") + DAY, F.lit(STEP))
    quarters = F.filter(steps, lambda t: _offset(F.col("zone"), t) != _offset(F.col("zone"), t - STEP))
    found = changed.select("zone", F.explode(quarters).alias("at"))
    return found.select("zone", "at", _offset(F.col("zone"), F.col("at") - STEP).alias("before"), _offset(F.col("zone"), F.col("at")).alias("after"))


def _first_offset(zones: DataFrame, first_year: int) -> DataFrame:
    start = F.unix_micros(F.to_timestamp(F.lit(f"{first_year}-01-01 00:00:00Z")))
    return zones.select("zone").distinct().select("zone", _offset(F.col("zone"), start).alias("first"))


def _bounds(first_year: int, last_year: int) -> tuple[Column, Column]:
    # a wall clock can be a day away from the instant
    return tuple(
        F.unix_micros(F.to_timestamp(F.lit(f"{year}-01-01 00:00:00Z"))) + F.lit(days * DAY) for year, days in ((first_year, -1), (last_year + 1, 1))
    )


def _filled(edges: DataFrame, zones: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """``zone, low, high, first, second, kind`` without holes: ``edges`` are the special segments, what lies between them is plain."""
    start, end = _bounds(first_year, last_year)
    order = Window.partitionBy("zone").orderBy("low")
    after = edges.select(
        "zone", F.col("high").alias("low"), F.coalesce(F.lead("low").over(order), end).alias("high"), F.col("second").alias("first"), "second"
    )
    ahead = edges.groupBy("zone").agg(F.min("low").alias("_edge"))
    before = _first_offset(zones, first_year).join(ahead, "zone", "left")
    before = before.select("zone", start.alias("low"), F.coalesce("_edge", end).alias("high"), "first", F.col("first").alias("second"))
    return edges.unionByName(before.unionByName(after).withColumn("kind", F.lit("plain"))).where("low < high")


def _binned(spans: DataFrame) -> DataFrame:
    bins = F.sequence(F.floor(F.col("low") / BIN), F.floor((F.col("high") - 1) / BIN))
    return spans.withColumn("bin", F.explode(bins))


def instant_spans(zones: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Spans of instants (epoch micros) with one offset each, binned for :func:`offset_at_instant`."""
    edges = zone_transitions(zones, first_year, last_year)
    edges = edges.select("zone", F.col("at").alias("low"), F.col("at").alias("high"), F.col("before").alias("first"), F.col("after").alias("second"))
    return _binned(_filled(edges.withColumn("kind", F.lit("edge")), zones, first_year, last_year))


def wall_spans(zones: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Segments of wall clock (micros of the local clock), binned for :func:`offset_at_wall_clock`.

    ``kind`` is ``plain``, ``overlap`` (the hour occurs twice) or ``gap`` (it never occurs); ``first`` is the offset in force before the
    change, ``second`` the one after it.
    """
    edges = zone_transitions(zones, first_year, last_year)
    low, high = (F.col("at") + f("before", "after").cast("bigint") * MINUTE for f in (F.least, F.greatest))
    kind = F.when(F.col("after") > F.col("before"), "gap").otherwise("overlap")
    edges = edges.select("zone", low.alias("low"), high.alias("high"), F.col("before").alias("first"), F.col("after").alias("second"), kind.alias("kind"))
    return _binned(_filled(edges, zones, first_year, last_year))


def _range_join(df: DataFrame, zone: str, micros: Column, spans: DataFrame) -> DataFrame:
    """``df`` with the span that holds ``micros`` in its zone as ``_span``; NULL for unknown zones and times outside the spans."""
    side = spans.select(
        F.col("zone").alias("_zone"), F.col("bin").alias("_bin"), F.struct("low", "high", "first", "second", "kind").alias("_span")
    )
    rows = df.withColumn("_at", micros)
    meets = (
        (rows[zone] == side["_zone"]) & (F.floor(rows["_at"] / BIN) == side["_bin"])
        & (rows["_at"] >= side["_span.low"]) & (rows["_at"] < side["_span.high"])
    )
    return rows.join(side, meets, "left").drop("_zone", "_bin", "_at")


def offset_at_wall_clock(df: DataFrame, zone: str, wall: str, spans: DataFrame, later: bool = False) -> DataFrame:
    """Add ``zone_kind`` and ``offset_minutes`` of the wall clock ``wall`` in ``zone``, by :func:`wall_spans`.

    An hour that occurs twice is its first one, or its second with ``later``. An hour that never occurs is read with the offset after the
    change. A NULL or unknown zone, a NULL time and one outside the years of the spans give NULL.
    """
    found = _range_join(df, zone, wall_micros(wall), spans)
    early = F.lit(not later) & (F.col("_span.kind") == "overlap")
    offset = F.when(early, F.col("_span.first")).otherwise(F.col("_span.second"))
    return found.withColumns({"zone_kind": F.col("_span.kind"), "offset_minutes": offset}).drop("_span")


def wall_clock_at(df: DataFrame, zone: str, instant: str, spans: DataFrame, out: str = "local_time") -> DataFrame:
    """Add the wall clock of the instant ``instant`` (UTC clock or timestamp) in ``zone``, by :func:`instant_spans`."""
    kind = dict(df.dtypes)[instant]
    micros = wall_micros(instant) if kind == "timestamp_ntz" else F.unix_micros(instant)
    found = _range_join(df.withColumn("_instant", micros), zone, F.col("_instant"), spans)
    local = wall_clock(F.col("_instant") + F.col("_span.second").cast("bigint") * MINUTE)
    return found.withColumn(out, local).drop("_span", "_instant")


def zone_lookup_at(df: DataFrame, abbr: str, wall: str, zones: DataFrame, names: DataFrame, spans: DataFrame) -> DataFrame:
    """:func:`gustline.operators.lookups.zone_lookup`, but an abbreviation with a region (``names``: abbr, zone) follows its rules at ``wall``."""
    fixed = zone_lookup(df, abbr, zones).withColumnRenamed("offset_minutes", "_fixed")
    named = names.select(F.upper("abbr").alias("_abbr"), F.col("zone").alias("_region"))
    found = fixed.join(named, F.upper(F.trim(F.col(abbr))) == F.col("_abbr"), "left").drop("_abbr")
    found = offset_at_wall_clock(found, "_region", wall, spans)
    return found.withColumn("offset_minutes", F.coalesce("offset_minutes", "_fixed")).drop("_fixed", "_region")
