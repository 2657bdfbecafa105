"""Canonical record, page tables, links and forecast sections."""

from pyspark.sql import functions as F

from gustline.functions.text import NULL_TOKEN
from gustline.operators import project, sections
from gustline.plans.registry import events, query, table
from gustline.schema import FIELDS, HISTORY_FIELDS
from gustline.session import fresh_folder
from gustline.sinks import tables
from gustline.sources import pages, textfiles

_GIVEN = {
    "station_id": ("event_type", "event_type"),
    "observation_time_rfc822": ("date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss')", "strftime(ts, '%a, %d %b %Y %H:%M:%S')"),
    "wind_mph": ("cast(value as string)", "CAST(value AS VARCHAR)"),
}


@query(
    "canonical_projection",
    "SELECT " + ", ".join(f'{_GIVEN[c][1] if c in _GIVEN else "CAST(NULL AS VARCHAR)"} AS "{c}"' for c in FIELDS) + ", event_id FROM events",
)
def canonical_projection(spark, sf_dir):
    given = events(spark, sf_dir).selectExpr("event_id", *[f"{v[0]} as {k}" for k, v in _GIVEN.items()])
    return project.canonical(given, keep=["event_id"])


@query(
    "typed_record",
    """
    SELECT event_id, value AS wind_mph, CAST(trunc(value) AS INTEGER) AS wind_degrees, date_trunc('minute', ts) AS obs_local, 'EST' AS tz_abbr
    FROM events
    """,
)
def typed_record(spark, sf_dir):
    given = events(spark, sf_dir).select(
        "event_id",
        F.concat(F.date_format("ts", "'Last Updated on 'MMM d yyyy, h:mm "), F.lower(F.date_format("ts", "a")), F.lit(" EST")).alias("observation_time"),
        F.col("value").cast("string").alias("wind_mph"),
        F.col("value").cast("int").cast("string").alias("wind_degrees"),
    )
    rows = project.typed(project.canonical(given, keep=["event_id"]))
    return rows.select("event_id", "wind_mph", "wind_degrees", "obs_local", "tz_abbr")


@query(
    "history_transform",
    """
    SELECT e.event_id, strftime(ts, '%b %-d %Y, %-I:%M %p EST') AS observation_time,
           strftime(ts, '%a, %b %d %Y %-H:%M:00') || ' -0500' AS observation_time_rfc822,
           n_name AS location,
           CASE user_id % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'Variable' ELSE 'NorthWest' END AS wind_dir,
           CASE user_id % 3 WHEN 0 THEN '0' ELSE CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR) END AS wind_mph,
           CASE user_id % 3 WHEN 2 THEN CAST(CAST(trunc(value) AS INTEGER) + 12 AS VARCHAR) END AS wind_gust_mph,
           CAST(user_id % 90 AS VARCHAR) AS temp_f,
           round(CAST(user_id % 90 - 32 AS DOUBLE) * CAST(0.5556 AS DOUBLE), 4) AS temp_c,
           'https://www.weather.gov/data/obhistory/' || CAST(n_nationkey AS VARCHAR) || '.html' AS two_day_history_url
    FROM events e LEFT JOIN nation ON user_id % 25 = n_nationkey
    """,
)
def history_transform(spark, sf_dir):
    wind = F.expr(
        "case user_id % 3 when 0 then 'Calm' when 1 then concat('Vrbl ', cast(cast(value as int) as string)) "
        "else concat('NW ', cast(cast(value as int) as string), ' G ', cast(cast(value as int) + 12 as string)) end"
    )
    none = F.lit(None).cast("string")
    rows = events(spark, sf_dir)
    history = rows.select(
        (F.col("user_id") % 25).cast("string").alias("station_id"),
        F.date_format("ts", "d").alias("Date"),
        F.date_format("ts", "HH:mm").alias("Time"),
        wind.alias("Wind (mph)"),
        F.lit("10.00").alias("Vis. (mi.)"),
        F.lit("Fair").alias("Weather"),
        (F.col("user_id") % 90).cast("string").alias("Air"),
        F.lit("30").alias("Dwpt"),
        F.lit("43%").alias("Relative Humidity"),
        none.alias("Wind Chill (°F)"),
        none.alias("Heat Index (°F)"),
        F.lit("30.32").alias("altimeter (in)"),
        F.lit("1026.8").alias("sea level (mb)"),
        F.date_format("ts", "yyyy").alias("Year"),
        F.date_format("ts", "M").alias("Month"),
        F.col("event_id").cast("string").alias("weather_id"),
    )
    stations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("station_id"),
        F.col("n_name").alias("location"),
        F.lit(38.8).alias("latitude"),
        F.lit(-77.0).alias("longitude"),
        F.lit("EST").alias("tz_abbr"),
        F.lit(-300).alias("offset_minutes"),
    )
    # the event id travels in the free weather field
    record = project.history_to_observations(history.drop("Weather").withColumnRenamed("weather_id", "Weather"), stations)
    return record.select(
        F.col("weather").cast("bigint").alias("event_id"), "observation_time", "observation_time_rfc822", "location",
        "wind_dir", "wind_mph", "wind_gust_mph", "temp_f", F.round(F.col("temp_c").cast("double"), 4).alias("temp_c"),
        "two_day_history_url",
    )


@query(
    "column_subset",
    "SELECT ts, user_id, value FROM events",
)
def column_subset(spark, sf_dir):
    return project.select_positions(events(spark, sf_dir), [1, 2, 4])


@query(
    "tide_table",
    """
    SELECT event_id, CAST(ts AS DATE) AS date, strftime(ts, '%a') AS day, strftime(ts, '%I:%M') AS time, strftime(ts, '%p') AS ampm,
           value AS pred_ft, CAST(user_id AS DOUBLE) AS pred_cm, CASE WHEN user_id % 2 = 0 THEN 'H' ELSE 'L' END AS high_low,
           strftime(ts, '%I:%M %p') AS tide_time FROM events
    """,
)
def tide_table(spark, sf_dir):
    # each reading is written as a prediction line and its header line; the header lines must go
    line = F.concat_ws(
        " ", F.date_format("ts", "yyyy/MM/dd EEE  hh:mm a"), F.col("value").cast("string"), F.col("user_id").cast("string"),
        F.when(F.col("user_id") % 2 == 0, "H").otherwise("L"),
    )
    lines = F.explode(F.array(F.lit("Date Day Time Pred(Ft) Pred(cm) High/Low"), line)).alias("line")
    return textfiles.tide_table(events(spark, sf_dir).select("event_id", lines), "line", ["event_id"])


@query(
    "page_links",
    r"""
    WITH v AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
         p AS (SELECT page_id, list_filter(string_split(h, '<a '), lambda s, i: i > 1) AS parts FROM v),
         t AS (SELECT page_id, [string_split(string_split(s, '>')[1], 'href=')[2] FOR s IN parts] AS hrefs FROM p),
         l AS (SELECT page_id, [replace(CASE WHEN s[1] = '"' THEN string_split(s, '"')[2] WHEN s[1] = chr(39) THEN string_split(s, chr(39))[2]
                                ELSE string_split(s, ' ')[1] END, '&amp;', '&') FOR s IN hrefs IF s IS NOT NULL] AS a FROM t)
    SELECT page_id, CAST(g.i AS INTEGER) AS link_no, a[g.i + 1] AS href
    FROM l, LATERAL (SELECT unnest(generate_series(0, len(a) - 1)) AS i) g WHERE len(a) >= 3
    """,
)
def page_links(spark, sf_dir):
    return pages.page_links(table(spark, sf_dir, "pages"), "html", ["page_id"])


@query(
    "quoted_links",
    """
    SELECT event_id, CAST(k AS INTEGER) AS link_no, CASE k WHEN 0 THEN 'a?x=' || event_type || '&y=1' WHEN 1 THEN 'b/' || CAST(user_id AS VARCHAR)
           ELSE 'c' || CAST(event_id AS VARCHAR) END AS href
    FROM events, LATERAL (SELECT unnest([0, 1, 2]) AS k)
    """,
)
def quoted_links(spark, sf_dir):
    """Links quoted in three ways, one with an entity, beside attributes whose names end in ``href``."""
    page = F.concat(
        F.lit('<p><a data-href="no" title="a > b" href="a?x='), "event_type", F.lit("&amp;y=1\">1</a> <A class=x href = 'b/"),
        F.col("user_id").cast("string"), F.lit("'>2</A><abbr href=no>3</abbr><a\nhref=c"), F.col("event_id").cast("string"),
        F.lit(" rel=next>4</a><a name='end'>5</a></p>"),
    )
    return pages.page_links(events(spark, sf_dir).select("event_id", page.alias("html")), "html", ["event_id"])


_HISTORY_DAYS = "date_add(DATE '2024-02-29', cast(event_id % 3 as int)) "


def _history_pages(spark, sf_dir):
    """A page of 2 March for every event, with its own row of one of the three days before and an odd row."""
    cells = [F.expr(f"cast(dayofmonth({_HISTORY_DAYS}) as string)"), F.date_format("ts", "HH:mm"), F.col("event_type")]
    cells += [F.lit(str(i)) for i in range(len(HISTORY_FIELDS) - len(cells) - 1)] + [F.col("value").cast("string")]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    page = F.concat(F.lit("<table><tr><th>Date</th></tr>"), row, F.lit("<tr><td>"), "event_type", F.lit("</td></tr></table>"))
    return events(spark, sf_dir).select("event_id", page.alias("html"))


@query(
    "history_rows",
    """
    SELECT event_id, CAST(day(d) AS VARCHAR) AS "Date", CAST(year(d) AS VARCHAR) AS "Year", CAST(month(d) AS VARCHAR) AS "Month",
           event_type AS wind, CAST(value AS VARCHAR) AS last
    FROM (SELECT *, CAST(DATE '2024-02-29' + CAST(event_id % 3 AS INTEGER) AS DATE) AS d FROM events)
    """,
)
def history_rows(spark, sf_dir):
    rows = pages.history_rows(_history_pages(spark, sf_dir), "html", ["event_id"], F.lit("2024-03-02").cast("date"))
    return rows.select("event_id", "Date", "Year", "Month", F.col(f"`{HISTORY_FIELDS[2]}`").alias("wind"),
                       F.col(f"`{HISTORY_FIELDS[-1]}`").alias("last"))


@query("history_rejects", "SELECT event_id, 2 AS row_no, event_type AS cell FROM events")
def history_rejects(spark, sf_dir):
    rows = pages.history_rejects(_history_pages(spark, sf_dir), "html", ["event_id"], F.lit("2024-03-02").cast("date"))
    return rows.select("event_id", "row_no", F.col("cells")[0].alias("cell"))


@query(
    "section_lines",
    """
    WITH s AS (SELECT conv_id, turn, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
                      ROWS UNBOUNDED PRECEDING) AS section_pos FROM conversations)
    SELECT conv_id, turn, section_pos, 'user' AS section, md5(text) AS line_md5 FROM s WHERE section_pos IS NOT NULL
    """,
)
def section_lines(spark, sf_dir):
    return _conversation_sections(spark, sf_dir).select(
        "conv_id", "turn", "section_pos", "section", F.md5("text").alias("line_md5")
    )


def _conversation_sections(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return sections.section_lines(turns, "conv_id", "turn", F.when(F.col("role") == "user", F.col("role")))


@query(
    "section_files",
    """
    WITH s AS (SELECT conv_id, turn, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
                      ROWS UNBOUNDED PRECEDING) AS section_pos FROM conversations)
    SELECT conv_id, section_pos, count(*) AS n_lines, md5(string_agg(text, chr(10) ORDER BY turn)) AS section_md5
    FROM s WHERE section_pos IS NOT NULL GROUP BY 1, 2
    """,
)
def section_files(spark, sf_dir):
    """Sections written line by line and read back; a conversation's sections are short enough to be joined for the comparison."""
    folder = fresh_folder(spark, "sections")
    rows = _conversation_sections(spark, sf_dir)
    tables.write_sections(rows, folder, "conv_id", "turn", "text")
    schema = rows.select("conv_id", "section_pos", "section", "turn", "text").schema
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    back = reader.option("nullValue", NULL_TOKEN).csv(folder)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    return back.groupBy("conv_id", "section_pos").agg(
        F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(in_order, "\n")).alias("section_md5")
    )


@query(
    "section_text",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
         h AS (SELECT *, count(*) FILTER (regexp_matches(line, '^[A-E]')) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM l)
    SELECT doc_id, CAST(n - 1 AS INTEGER) AS section_no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS section_text
    FROM h WHERE n > 0 GROUP BY 1, 2
    """,
)
def section_text(spark, sf_dir):
    """Sections inside the document's own cell; a line that begins with A to E opens one."""
    return sections.cell_sections(table(spark, sf_dir, "documents"), "text", ["doc_id"], "[A-E]")


@query(
    "forecast_section",
    r"""
    SELECT doc_id, md5('ANZ535 area' || chr(10) || regexp_replace(replace(text, 'ANZ', 'anz'), '(?m)\.$', '.' || chr(10), 'g')
           || chr(10)) AS section_md5 FROM documents
    """,
)
def forecast_section(spark, sf_dir):
    # each whole document is the body of one section between two other stations' sections
    body = F.replace("text", F.lit("ANZ"), F.lit("anz"))
    forecast = F.concat(F.lit("preamble\nANZ530 bay\nwinds.\nANZ535 area\n"), body, F.lit("\nANZ536 river\nwinds."))
    found = sections.forecast_section(forecast, "ANZ535")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(found).alias("section_md5"))


