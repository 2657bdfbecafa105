"""Sections of forecast text: a header line opens a section that runs to the next header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions.text import strip_tags
from gustline.operators.ordered import ROWS_PER_SLICE, ordered


def section_lines(
    lines: DataFrame,
    doc: str,
    pos: str,
    header: Column,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Give each line row the position (``section_pos``) and value (``section``) of its header.

    ``header`` is the header's value on a header line and NULL on others. Lines before the first
    header are dropped. Output stays one row per line, so a section may be of any length.
    """
    opened = F.when(header.isNotNull(), F.struct(F.col(pos).alias("pos"), header.alias("header")))
    scan = ordered(lines, [doc], [pos], rows_per_slice).running_max("_open", opened)
    return (
        scan.done()
        .where(F.col("_open").isNotNull())
        .withColumns({"section_pos": F.col("_open.pos"), "section": F.col("_open.header")})
        .drop("_open")
    )


def cell_sections(df: DataFrame, text: str, keep: list[str], header: str) -> DataFrame:
    """Sections of a text that sits in one cell: ``section_no`` (from 0), ``n_lines`` and ``section_text``.

    ``header`` is a pattern for the start of a header line. Lines before the first header are dropped; a
    text without one, or a NULL text, has no section. For lines in rows of their own use
    :func:`section_lines`, whose sections may be of any length.
    """
    found = F.filter(F.split(text, rf"(?m)^(?={header})"), lambda p: p.rlike(rf"\A(?:{header})"))
    body = F.regexp_replace(F.col("_s"), r"\n\z", "")
    return df.select(*keep, F.posexplode(found).alias("section_no", "_s")).select(
        *keep, "section_no", F.size(F.split(body, "\n", -1)).cast("bigint").alias("n_lines"), body.alias("section_text")
    )


def forecast_section(text: Column | str, station: str, header: str = "ANZ") -> Column:
    """The part of a forecast text under ``station``: its header line up to the next other header.

    Works inside one cell without a shuffle. A line that ends in a full stop is followed by an empty
    line. No such header gives empty text.
    """
    parts = F.split(text, rf"(?m)^(?={header})")
    own = F.filter(parts, lambda p: p.startswith(station))
    ended = F.transform(own, lambda p: F.regexp_replace(p, r"(?m)\.$", ".\n"))
    return F.array_join(ended, "")


def paragraph_text(html: Column | str) -> Column:
    """Text of a page's paragraphs, one after the other; a highlighted warning is followed by an empty line."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)(<p\b.*?(?:</p>|(?=<p\b)|\z))"), F.lit(1))

    def lines(block: Column) -> Column:
        text, warning = strip_tags(block), block.rlike(r'(?i)^<p[^>]*class="warn-highlight')
        return F.when(warning, F.concat(text, F.lit("\n\n"))).otherwise(text)

    return F.array_join(F.transform(blocks, lines), "\n")


def bulletin_section(html: Column | str, station: str) -> Column:
    """The first zone block (``ANZ535-111111`` to the next such header or the tail) that names ``station``."""
    html = F.col(html) if isinstance(html, str) else html
    body = F.regexp_replace(html, r"(?s).{0,5}Start Tail.*$", "")
    blocks = F.filter(F.split(body, r"(?=\w{3}\d{3}\W\d{6})"), lambda b: b.rlike(r"^\w{3}\d{3}\W\d{6}"))
    own = F.filter(blocks, lambda b: b.contains(station))
    return F.coalesce(strip_tags(F.get(own, F.lit(0))), F.lit("<not found>"))
