"""Unit conversion, compass points, wind text and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustline.functions.times import as_col

# Conversion factors and the eight compass points.
KNOTS_PER_MPH = 0.868976
CELSIUS_FACTOR = 0.5556
COMPASS = (
    ("N", "North", 0),
    ("NE", "NorthEast", 45),
    ("E", "East", 90),
    ("SE", "SouthEast", 135),
    ("S", "South", 180),
    ("SW", "SouthWest", 225),
    ("W", "West", 270),
    ("NW", "NorthWest", 315),
)


def number(c: Column | str) -> Column:
    """Text -> double, NULL when it is not a number.

    The shape test comes first because a failed cast is an exception inside Spark.
    """
    text = F.trim(as_col(c).cast("string"))
    return F.when(text.rlike(r"^[-+]?\.?\d"), text.try_cast("double"))


def knots(mph: Column | str) -> Column:
    return as_col(mph) * F.lit(KNOTS_PER_MPH)


def celsius(fahrenheit: Column | str) -> Column:
    return (as_col(fahrenheit) - F.lit(32.0)) * F.lit(CELSIUS_FACTOR)


def _compass_map(position: int) -> Column:
    pairs = [x for p in COMPASS for name in {p[0], p[1].upper()} for x in (F.lit(name), F.lit(p[position]))]
    return F.create_map(*pairs)


def compass_degrees(c: Column | str) -> Column:
    """Abbreviation or full name, any case -> degrees; -1 when unknown."""
    return F.coalesce(F.try_element_at(_compass_map(2), F.upper(F.trim(as_col(c)))), F.lit(-1))


def compass_text(c: Column | str) -> Column:
    """Abbreviation or full name, any case -> full name; NULL when unknown."""
    return F.try_element_at(_compass_map(1), F.upper(F.trim(as_col(c))))


def wind_parts(c: Column | str) -> Column:
    """``NW 8 G 25``, ``Calm``, ``Vrbl 5`` -> direction, degrees, speed and gust (number and text), flags."""
    parts = F.split(F.trim(as_col(c)), r"\s+")
    head = F.get(parts, F.lit(0))
    calm, variable = head == "Calm", head == "Vrbl"
    direction = F.when(calm, "North").when(variable, "Variable").otherwise(compass_text(head))
    speed = F.when(calm, "0").otherwise(F.get(parts, F.lit(1)))
    gust = F.when(F.size(parts) > 2, F.get(parts, F.lit(3)))
    return F.struct(
        direction.alias("direction"),
        compass_degrees(direction).alias("degrees"),
        number(speed).alias("mph"),
        number(gust).alias("gust_mph"),
        speed.alias("mph_text"),
        gust.alias("gust_text"),
        calm.alias("calm"),
        variable.alias("variable"),
    )


def _text(c: Column | str) -> Column:
    return as_col(c).cast("string")


def _knots_text(mph: Column) -> Column:
    return knots(number(mph)).cast("string")


def wind_display(direction: Column | str, mph: Column | str, gust: Column | str) -> Column:
    """``from the North at 8 gusting to 25 MPH (.. KT gusting to .. KT)``, shorter without a gust.

    Speeds are shown as given, text or number; knots are computed.
    """
    direction, mph, gust = as_col(direction), as_col(mph), as_col(gust)
    plain = F.concat(direction, F.lit(" at "), _text(mph), F.lit(" MPH ("), _knots_text(mph), F.lit(" KT)"))
    gusty = F.concat(
        F.lit("from the "), direction, F.lit(" at "), _text(mph), F.lit(" gusting to "), _text(gust),
        F.lit(" MPH ("), _knots_text(mph), F.lit(" KT gusting to "), _knots_text(gust), F.lit(" KT)"),
    )
    return F.when(gust.isNull(), plain).otherwise(gusty)


def temperature_display(fahrenheit: Column | str, gap: str = " ") -> Column:
    """``69.1 F (20.6 C)``; NULL in, NULL out. Fahrenheit is shown as given."""
    f = as_col(fahrenheit)
    return F.concat(_text(f), F.lit(" F ("), celsius(number(f)).cast("string"), F.lit(gap + "C)"))


def pressure_display(millibar: Column | str) -> Column:
    return F.concat(_text(millibar), F.lit(" mb"))
