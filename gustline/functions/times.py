"""Time parsing, arithmetic and naming.

Local times are ``timestamp_ntz`` (wall clock at the station), absolute times are ``timestamp``.
Arithmetic goes through epoch micros, so no session zone or daylight-saving rule can shift a wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustline.functions.dates import MONTHS, parse_date  # noqa: F401 - dates belong to times

HOUR_MICROS = 3_600_000_000


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _epoch() -> Column:
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))


def wall_micros(c: Column | str) -> Column:
    """Micros of a wall-clock time since 1970-01-01 00:00 of the same clock."""
    return F.timestamp_diff("MICROSECOND", _epoch(), as_col(c))


def wall_clock(micros: Column) -> Column:
    """Inverse of :func:`wall_micros`."""
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def utc_clock(c: Column | str) -> Column:
    """Absolute time -> wall clock at UTC."""
    return wall_clock(F.unix_micros(as_col(c)))


def hours(n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(hours=n.cast("int"))


def hour_floor(c: Column | str) -> Column:
    """Wall clock cut to the full hour, staying ``timestamp_ntz``."""
    c = as_col(c)
    return F.to_date(c).cast("timestamp_ntz") + hours(F.hour(c))


def day_floor(c: Column | str) -> Column:
    return F.to_date(as_col(c)).cast("timestamp_ntz")


def hour_diff(later: Column | str, earlier: Column | str) -> Column:
    """Difference of two wall-clock times in hours, fractional."""
    return F.timestamp_diff("MICROSECOND", as_col(earlier), as_col(later)) / F.lit(float(HOUR_MICROS))


# --- parsing ---------------------------------------------------------------------------------------


def _first_shape(text: Column, shapes: tuple[tuple[str, str], ...], parse) -> Column:
    """Parse with the pattern of the first shape that fits. A failed parse is an exception inside Spark and
    costs more than the test, so no pattern is tried on a text that cannot match."""
    (shape, pattern), *others = shapes
    chosen = F.when(text.rlike(shape), parse(text, pattern))
    for shape, pattern in others:
        chosen = chosen.when(text.rlike(shape), parse(text, pattern))
    return chosen


def _instant(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def parse_local_time(c: Column | str) -> Column:
    """``Jan 29 2021, 8:52 am EST`` (any lead text, optional seconds and zone) -> wall clock, else NULL."""
    plain = F.regexp_replace(
        as_col(c),
        r"^.*?\b([A-Za-z]{3})[a-z]* +(\d{1,2}),? +(\d{4}),? +(\d{1,2}:\d{2})(:\d{2})? *([AaPp][Mm])\b.*$",
        "$1 $2 $3 $4$5 $6 +0000",
    )
    parsed = _instant(plain, "MMM d yyyy h:mm[:ss] a xx")
    return utc_clock(F.when(plain.endswith(" +0000"), parsed))


def parse_plain_time(c: Column | str) -> Column:
    """Spreadsheet and ISO forms: ``6/28/2022 17:40``, ``06/28/22 17:40:00``, ``2022-06-28 17:40:00``."""
    shapes = (
        (r"^\d{1,2}/\d{1,2}/\d{4} +\d", "M/d/yyyy H:mm[:ss] xx"),
        (r"^\d{1,2}/\d{1,2}/\d{2} +\d", "M/d/yy H:mm[:ss] xx"),
        (r"^\d{4}-\d{1,2}-\d{1,2} +\d", "yyyy-M-d H:mm[:ss] xx"),
    )
    return utc_clock(_first_shape(F.concat(F.trim(as_col(c)), F.lit(" +0000")), shapes, _instant))


def parse_rfc_time(c: Column | str) -> Column:
    """``Fri, 29 Jan 2021 08:52:00 -0500`` or ``Fri, Jan 29 2021 8:52:00 -0500`` -> absolute time."""
    shapes = (
        (r"^\d{1,2} [A-Za-z]{3} \d{4} ", "d MMM yyyy H:mm:ss xx"),
        (r"^[A-Za-z]{3} \d{1,2} \d{4} ", "MMM d yyyy H:mm:ss xx"),
    )
    return _first_shape(F.regexp_replace(F.trim(as_col(c)), r"^[A-Za-z]+, *", ""), shapes, _instant)


def rfc_offset_minutes(c: Column | str) -> Column:
    """Offset at the end of an RFC time in minutes east of UTC."""
    tail = F.right(F.rtrim(as_col(c)), F.lit(5))
    hhmm = F.when(tail.startswith("-") | tail.startswith("+"), tail.try_cast("int"))
    return (F.signum(hhmm) * (F.floor(F.abs(hhmm) / 100) * 60 + F.abs(hhmm) % 100)).cast("int")


def utc_offset_minutes(c: Column | str) -> Column:
    """``UTC+05:30`` -> 330, ``UTC-05`` -> -300; anything else, such as two offsets, -> NULL."""
    c = as_col(c)
    shape = r"^UTC([^\d])(\d{1,2})(?::(\d{2}))?$"
    sign = F.when(F.regexp_extract(c, shape, 1).isin("-", "\u2212"), -1).otherwise(1)
    hh, mm = F.regexp_extract(c, shape, 2), F.regexp_extract(c, shape, 3)
    minutes = F.when(mm != "", mm.try_cast("int")).otherwise(0)
    return F.when(hh != "", sign * (hh.try_cast("int") * 60 + minutes))


def parse_rfc_local(c: Column | str) -> Column:
    """Wall clock written in an RFC time, whatever its offset."""
    return wall_clock(F.unix_micros(parse_rfc_time(c)) + rfc_offset_minutes(c) * F.lit(60_000_000).cast("bigint"))


def parse_time(c: Column | str) -> Column:
    """Any accepted text -> wall clock. A ``-`` in the text selects the RFC and ISO forms."""
    c = as_col(c)
    dashed = F.coalesce(parse_rfc_local(c), parse_plain_time(c))
    return F.when(c.contains("-"), dashed).otherwise(F.coalesce(parse_local_time(c), parse_plain_time(c)))


def zone_abbreviation(c: Column | str) -> Column:
    """Trailing zone letters of a local time, upper case; NULL for none, am/pm or digits."""
    last = F.upper(F.substring_index(F.rtrim(as_col(c)), " ", -1))
    return F.when(last.rlike("^[A-Z]{2,5}$") & ~last.isin("AM", "PM"), last)


def month_number(c: Column | str) -> Column:
    """Month name, three-letter abbreviation or number text (1-12) -> 1-12, else NULL."""
    pairs = []
    for number, name in enumerate(MONTHS, 1):
        for key in sorted({name, name[:3], str(number), f"{number:02d}"}):
            pairs += [F.lit(key), F.lit(number)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(as_col(c))))


def year_number(c: Column | str) -> Column:
    """Year text -> number between 1901 and 9998, else NULL."""
    text = F.trim(as_col(c))
    year = F.when(text.rlike(r"^\d{4}$"), text.cast("int"))
    return F.when((year > 1900) & (year < 9999), year)


def is_month(c: Column | str) -> Column:
    return F.coalesce(month_number(as_col(c)).isNotNull() & ~as_col(c).rlike(r"\d"), F.lit(False))


# --- arithmetic ------------------------------------------------------------------------------------


def is_future(c: Column | str, other: Column | str) -> Column:
    """More than one hour ahead of ``other``, zones ignored."""
    return as_col(c) > as_col(other) + hours(1)


def local_now(offset_minutes: Column | str, as_of: Column | None = None) -> Column:
    """Wall clock at a UTC offset for the instant ``as_of`` (default: the query's start)."""
    instant = F.unix_micros(as_of if as_of is not None else F.current_timestamp())
    return wall_clock(instant + as_col(offset_minutes) * F.lit(60_000_000).cast("bigint"))


def calendar_fields(c: Column | str) -> dict[str, Column]:
    c = as_col(c)
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "hour": F.hour(c),
        "minute": F.minute(c),
        "midnight": day_floor(c),
        "seconds_of_day": F.timestamp_diff("SECOND", day_floor(c), c),
    }


def month_distance(a: Column | str, b: Column | str) -> Column:
    a, b = as_col(a), as_col(b)
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))


def month_starts(a: Column | str, b: Column | str) -> Column:
    """Array of the first days of every month from ``a`` to ``b``, both included."""
    first, last = F.trunc(as_col(a), "MM"), F.trunc(as_col(b), "MM")
    return F.sequence(first, last, F.make_ym_interval(months=F.lit(1)))


# --- output ----------------------------------------------------------------------------------------


def _offset_text(minutes: Column, separator: str) -> Column:
    sign = F.when(minutes < 0, "-").otherwise("+")
    whole = F.abs(minutes)
    pad = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return F.concat(sign, pad(F.floor(whole / 60)), F.lit(separator), pad(whole % 60))


def emit_time(c: Column | str, kind: str, offset_minutes: Column | None = None, zone: Column | None = None) -> Column:
    """Wall clock -> text as ``rfc``, ``reg``, ``excel`` or ``dt``; other kinds raise ``ValueError``."""
    c = as_col(c)
    if kind == "rfc":
        text = F.date_format(c, "EEE, MMM dd yyyy H:mm:ss")
        return text if offset_minutes is None else F.concat_ws(" ", text, _offset_text(offset_minutes, ""))
    if kind == "reg":
        text = F.concat(F.date_format(c, "MMM dd yyyy, h:mm:ss "), F.lower(F.date_format(c, "a")))
        return text if zone is None else F.concat_ws(" ", text, zone)
    if kind == "excel":
        return F.date_format(c, "MM/dd/yy HH:mm:ss")
    if kind == "dt":
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return text if offset_minutes is None else F.concat(text, _offset_text(offset_minutes, ":"))
    raise ValueError(f"unknown time format: {kind}")


def file_key(station: Column | str, c: Column | str, ext: str = "csv") -> Column:
    """Daily file name ``<station>_Y2021_M01_D29_H08.csv``."""
    return F.concat(as_col(station), F.date_format(as_col(c), "'_Y'yyyy'_M'MM'_D'dd'_H'HH"), F.lit("." + ext))


def day_file_key(station: Column | str, day: Column | str, ext: str = "csv") -> Column:
    return file_key(station, as_col(day).cast("timestamp_ntz"), ext)


def range_file_key(station: Column | str, start: Column | str, end: Column | str, ext: str = "csv") -> Column:
    days = F.datediff(F.to_date(as_col(end)), F.to_date(as_col(start)))
    name = F.regexp_replace(file_key(station, as_col(start), ext), rf"\.{ext}$", "")
    return F.concat(name, F.lit("_Range"), days.cast("string"), F.lit("." + ext))


def month_file_key(station: Column | str, c: Column | str, ext: str = "csv") -> Column:
    first = F.trunc(as_col(c), "MM").cast("timestamp_ntz")
    return F.regexp_replace(file_key(station, first, ext), rf"\.{ext}$", f"_Monthly.{ext}")


def year_file_key(station: Column | str, c: Column | str, ext: str = "csv") -> Column:
    first = F.trunc(as_col(c), "YEAR").cast("timestamp_ntz")
    return F.regexp_replace(file_key(station, first, ext), rf"\.{ext}$", f"_Yearly.{ext}")


def date_of_file(name: Column | str) -> Column:
    """Date inside a daily file name, NULL when the name does not carry one."""
    iso = F.regexp_replace(as_col(name), r"^.*_Y(\d{4})_M(\d{2})_D(\d{2}).*$", "$1-$2-$3")
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd"))
