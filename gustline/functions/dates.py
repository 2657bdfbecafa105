"""Free-form dates: one pattern takes a text apart, drops what carries no date and leaves month names and numbers, whose order is then
solved from what they can be.

All of it is built-in functions, so it stays in the JVM; the pattern is possessive, so no part of a text is tried twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month and weekday names in calendar order.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# Words that carry no date: parts of a time, zones, day endings, joining words.
PASSED_OVER = (
    "st", "nd", "rd", "th", "t", "z", "of", "the", "at", "on", "and", "am", "pm", "a", "p", "m", "utc", "gmt", "est", "edt", "cst",
    "cdt", "mst", "mdt", "pst", "pdt", "akst", "akdt", "hst", "chst", "sst", "ast", "adt",
)

# A clock time, a zone offset behind a time, the hour before am or pm, a T and the time behind it.
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
_OFFSET = r"(?<=:\d\d\s?|:\d\d\.\d{3}\s?|m\s|t\d{4}|t\d{6})[+-]\d{2}:?\d{2}\b"
_HOUR = r"\d{1,2}+(?!\d)(?=\s*+[ap]m?+(?![a-z]))"
_BEHIND_T = rf"t(?![a-z])(?:(?<=\dt)(?!{_CLOCK})\d{{1,6}}+|\s*+(?!{_CLOCK})\d{{1,14}}+(?!\d))?+"
_SEPARATORS = r"[\s/.,']++"
# Years of two digits from this one on are in the last century.
CENTURY_FROM = 70


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _passed_over() -> str:
    """What carries no date."""
    words = {*PASSED_OVER, *WEEKDAYS, *(d[:3] for d in WEEKDAYS), "tues", "thur", "thurs"}
    starts = "|".join(
        f"{c}(?:{'|'.join(sorted(w[1:] for w in words if w[0] == c))})" for c in sorted({w[0] for w in words})
    )
    return rf"{_SEPARATORS}|(?=\d)(?:{_CLOCK}|{_HOUR})|(?=[a-z])(?:{_BEHIND_T}|(?:{starts})(?![a-z]))|{_OFFSET}|-"


def _month_names() -> str:
    """The first three letters of a month name, from a word that is one."""
    rest = {name[:3]: name[3:] for name in MONTHS} | {"sep": "t(?:ember)?"}
    return "|".join(f"{short}(?=(?:{more})?(?![a-z]))" for short, more in rest.items())


# A month name, or any other word, number or sign, with what carries no date before it (at the start of the text only) and behind it.
_PASSED = f"(?:{_passed_over()})*+"
_KEPT = rf"(?:^{_PASSED})?(?:(?:(\d++|[^\sa-z\d])|({_month_names()})[a-z]*+|([a-z]++)){_PASSED}|\z)"


def _classified(token: Column) -> Column:
    """``kind`` (m month, n number, ? unknown), ``value``, ``size`` and ``text`` of what was kept."""
    months = F.lit(",".join(name[:3] for name in MONTHS))
    size = F.length(token)
    digits = (token >= "0") & (token < ":") & (size <= 14)
    month = F.when(~digits, F.nullif(F.find_in_set(token, months), F.lit(0)))
    value = F.when(digits & (size <= 8), token).try_cast("int")
    # three digits or more are a year as they stand, which cannot be below 100
    value = F.when((size <= 2) | (value >= 100), value)
    kind = F.when(digits, "n").when(month.isNotNull(), "m").otherwise("?")
    return F.struct(kind.alias("kind"), F.coalesce(month, value).alias("value"), size.alias("size"), token.alias("text"))


def _part(text: Column, start: int, size: int) -> Column:
    return F.substring(text, start, size).try_cast("int")


def _triple(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))


def _solved(names: Column, numbers: Column, place: Column, whole: Column) -> Column:
    """Year, month and day from month names, the other numbers and the place of the name among them."""
    one = F.lit(1)
    a, b, c = (F.get(numbers, F.lit(i))["value"] for i in range(3))
    size_a, size_b = (F.get(numbers, F.lit(i))["size"] for i in range(2))
    month = F.get(names, F.lit(0))["value"]
    year_a, year_b = (a > 31) | (size_a > 2), (b > 31) | (size_b > 2)
    n = F.size(numbers)
    # with a month name: of two numbers the year is the one that can be no day, else the later one, or the first if the name comes last
    first_is_year = F.when(year_a, True).when(year_b, False).otherwise(place == 2)
    named = F.when(
        n == 2, F.when(first_is_year, _triple(a, month, b)).otherwise(_triple(b, month, a))
    ).when((n == 1) & year_a, _triple(a, month, one))

    def three(first: Column, second: Column, third: Column, is_year: Column) -> Column:
        by_size = F.when(first > 12, _triple(third, second, first)).otherwise(_triple(third, first, second))
        return F.when(is_year, _triple(first, second, third)).otherwise(by_size)

    two = F.when(year_a, _triple(a, b, one)).when(year_b, _triple(b, a, one))
    single = (
        F.when(size_a.isin(8, 12, 14), _triple(_part(whole, 1, 4), _part(whole, 5, 2), _part(whole, 7, 2)))
        .when(size_a == 6, three(_part(whole, 1, 2), _part(whole, 3, 2), _part(whole, 5, 2), _part(whole, 1, 2) > 31))
        .when(size_a == 4, _triple(a, one, one))
    )
    return F.when(F.size(names) == 1, named).when(F.size(names) == 0, F.when(n == 3, three(a, b, c, year_a)).when(n == 2, two).when(n == 1, single))


def _dated(parts: Column) -> Column:
    """The day of year, month and day; NULL if there is none, and for years after 9999."""
    year = F.when(parts["y"] >= 100, parts["y"]).when(parts["y"] >= CENTURY_FROM, parts["y"] + 1900).otherwise(parts["y"] + 2000)
    fits = year.between(100, 9999) & parts["m"].between(1, 12) & (parts["d"] >= 1)
    first = F.when(fits, F.make_date(year, parts["m"], F.lit(1)))
    return let(first, lambda day: F.when(parts["d"] <= F.dayofmonth(F.last_day(day)), F.date_add(day, parts["d"] - 1)))


def parse_date(c: Column | str) -> Column:
    """Free-form date text -> date, NULL for a text with anything unknown in it or without a year.

    Month names in any case, full or as three letters, weekdays, day endings (``1st``), clock times, am and pm and zones may stand
    anywhere. Numbers without a month name are month, day, year; day, month, year if the first is above 12; year, month, day if it is
    above 31 or has more than two digits. A month without a day is its first day, a year alone its first of January. One number alone is
    ``yyyymmdd`` (time behind it or not), a year, or, with six digits, three numbers of two. Two-digit years are 1970 to 2069. A text of more than 100 characters is none.
    """
    text = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    kept = F.array_remove(F.split(F.regexp_replace(F.when(F.length(text) <= 100, text), F.lit(_KEPT), F.lit("$1$2$3 ")), " "), "")
    # a date has three parts at most
    return let(kept, lambda words: let(F.when(F.size(words) <= 3, F.transform(words, _classified)), _from_tokens))


def _from_tokens(kept: Column) -> Column:
    sorted_out = F.struct(
        F.filter(kept, lambda x: x["kind"] == "m").alias("names"),
        F.filter(kept, lambda x: x["kind"] == "n").alias("numbers"),
        (F.array_position(kept["kind"], "m") - 1).alias("place"),
    )
    unknown = F.exists(kept, lambda x: x["kind"] == "?")
    solved = let(sorted_out, lambda x: _solved(x["names"], x["numbers"], x["place"], F.get(x["numbers"], F.lit(0))["text"]))
    return let(F.when(~unknown, solved), _dated)
