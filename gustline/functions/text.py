"""String functions: keys from URLs, prefixes, fingerprints and markup fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustline.functions.times import as_col

NULL_TOKEN = "<no_value_provided>"


def strip_update_prefix(c: Column | str) -> Column:
    """Drop the lead text ``Last Updated on``."""
    return F.trim(F.regexp_replace(as_col(c), r"^\s*Last Updated on\s*", ""))


def station_of_url(url: Column | str) -> Column:
    """Four-letter station of ``.../KDCA.xml``; NULL when the URL has another shape."""
    found = F.regexp_extract(F.trim(as_col(url)), r"([A-Za-z0-9]{4})\.xml$", 1)
    return F.when(found != "", F.upper(found))


def fingerprint(c: Column | str) -> Column:
    return F.md5(as_col(c))


def without_token(c: Column | str) -> Column:
    """The no-value token and empty text -> NULL."""
    text = F.trim(as_col(c))
    return F.when((text != "") & (text != NULL_TOKEN), text)


def html_escape(c: Column | str) -> Column:
    text = F.replace(as_col(c).cast("string"), F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def html_row(*cells: Column | str) -> Column:
    """One ``<tr>`` from cells; NULL cells show the no-value token."""
    shown = [F.coalesce(html_escape(c), F.lit("&lt;no_value_provided&gt;")) for c in cells]
    tagged = [F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in shown]
    return F.concat(F.lit("<tr>"), *tagged, F.lit("</tr>"))


def visible_html(c: Column | str) -> Column:
    """Markup without scripts, styles and comments. One that is never closed goes on to the end, so no part is searched twice."""
    return F.regexp_replace(as_col(c), r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)", "")


def strip_tags(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(c), r"<[^<>]*+>", ""))


# Entities of markup; the ampersand is decoded last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(c: Column | str) -> Column:
    text = as_col(c)
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def column_name(raw: str) -> str:
    """Header cell -> column name: blanks and quotes stripped, inner blanks to underscores."""
    return raw.strip().strip('"').replace(" ", "_")
