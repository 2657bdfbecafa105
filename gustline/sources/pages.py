"""Tables and links inside HTML pages, by native string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions.text import decode_entities, strip_tags, visible_html
from gustline.schema import HISTORY_FIELDS


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _kept(items: Column, min_items: int) -> Column:
    """Generator of ``items`` if there are enough of them, else of NULL.

    Wrapping the array makes it a row value that later steps read back: filtering on its size directly
    would have the regular expressions run once for the filter and again for every use.
    """
    return F.explode_outer(F.filter(F.array(items), lambda a: F.size(a) >= min_items))


# Rows and cells end where the next one begins at the latest. No pattern here looks at a character twice, or deeper with every one.
_ROW = r"(?is)<tr\b[^<>]*+>(.*?)(?:</tr>|(?=<tr\b)|\z)"
_CELL = r"(?is)<td\b[^<>]*+>(.*?)(?:</td>|(?=<td\b)|\z)"


def table_rows(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """One row per ``<tr>`` with the text of its ``<td>`` cells; header rows have none."""
    rows = _all(visible_html(html), _ROW)
    cells = F.transform(_all(F.col("_tr"), _CELL), strip_tags)
    return (
        pages.select(*keep, _kept(rows, 1).alias("_rows"))
        .select(*keep, F.posexplode("_rows").alias("row_no", "_tr"))
        .select(*keep, "row_no", cells.alias("cells"))
    )


def _history_cells(pages: DataFrame, html: str, keep: list[str], page_date: Column) -> tuple[DataFrame, Column]:
    cells = table_rows(pages.withColumn("_page_date", page_date), html, [*keep, "_page_date"]).where(F.size("cells") > 0)
    day = F.expr("try_cast(get(cells, 0) as int)")
    return cells.withColumn("_day", day), (F.size("cells") == len(HISTORY_FIELDS)) & day.between(1, 31)


def history_rows(pages: DataFrame, html: str, keep: list[str], page_date: Column) -> DataFrame:
    """Three-day-history table -> its 18 columns (by position) plus Year and Month, newest row first.

    A row carries the day of the month only. It lies in the month of ``page_date``, or in the month before
    if its day is later than the page's. Other rows with cells go to :func:`history_rejects`.
    """
    cells, fits = _history_cells(pages, html, keep, page_date)
    value = lambda i: F.when(F.col("cells")[i] != "", F.col("cells")[i])
    month = F.add_months(F.trunc("_page_date", "MM"), F.when(F.col("_day") > F.dayofmonth("_page_date"), -1).otherwise(0))
    return cells.where(F.coalesce(fits, F.lit(False))).select(
        *keep, "row_no", *[value(i).alias(name) for i, name in enumerate(HISTORY_FIELDS)],
        F.year(month).cast("string").alias("Year"), F.month(month).cast("string").alias("Month"),
    )


def history_rejects(pages: DataFrame, html: str, keep: list[str], page_date: Column) -> DataFrame:
    """Rows with cells that are no history row: another number of cells, or no day of the month."""
    cells, fits = _history_cells(pages, html, keep, page_date)
    return cells.where(~F.coalesce(fits, F.lit(False))).select(*keep, "row_no", "cells")


# A start tag; quoted values may hold any character, what is not quoted no other tag.
_ANCHOR = r"""(?i)(<a\s(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>)"""


def link_target(tag: Column) -> Column:
    """``href`` of a start tag, quoted either way or bare, with entities decoded; NULL without one."""
    quoted = lambda pattern: F.regexp_extract_all(tag, F.lit(r"(?i)\shref\s*=\s*" + pattern), F.lit(1))
    found = F.concat(quoted('"([^"]*)"'), quoted("'([^']*)'"), quoted(r"""([^\s"'>]+)"""))
    return decode_entities(F.get(found, F.lit(0)))


def page_links(pages: DataFrame, html: str, keep: list[str], min_links: int = 3) -> DataFrame:
    """Visible links of each page in order, for pages with at least ``min_links`` of them."""
    links = F.filter(F.transform(_all(visible_html(html), _ANCHOR), link_target), lambda x: x.isNotNull())
    found = pages.select(*keep, _kept(links, min_links).alias("_links"))
    return found.select(*keep, F.posexplode("_links").alias("link_no", "href"))


def station_directory(pages: DataFrame, html: str, state: str) -> DataFrame:
    """State pages -> station name, links of its row and state; rows with fewer than 3 linked cells are dropped."""
    rows = _all(visible_html(html), _ROW)
    row = pages.select(F.upper(state).alias("state"), _kept(rows, 1).alias("_rows")).select(
        "state", F.explode("_rows").alias("_tr")
    )
    cells = _all(F.col("_tr"), _CELL)
    links = F.filter(F.transform(cells, lambda c: link_target(F.get(_all(c, _ANCHOR), F.lit(0)))), lambda x: x.isNotNull())
    name = decode_entities(strip_tags(F.get(cells, F.lit(0))))
    found = row.select("state", "_tr", _kept(links, 3).alias("links")).where(F.col("links").isNotNull())
    xml = F.get(F.filter("links", lambda x: x.endswith(".xml")), F.lit(0))
    return found.select("state", name.alias("name"), xml.alias("xml"), "links")
