"""XML, JSON and HTML shapes of observation rows."""

from pyspark.sql import functions as F

from gustline.functions.times import hour_floor, parse_local_time
from gustline.functions.units import number
from gustline.operators import audit, summary
from gustline.operators.latest import latest_per_key
from gustline.plans.registry import events, query, table
from gustline.session import fresh_folder
from gustline.sinks import tables, xmltemplate
from gustline.sources import extra, observations, pages


@query(
    "html_fragment",
    """
    WITH h AS (SELECT user_id AS station, date_trunc('hour', ts) AS obs_hour, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
    SELECT station, CAST(obs_hour AS DATE) AS obs_date,
           '<table>' || string_agg('<tr><td>' || strftime(obs_hour, '%H:%M') || '</td><td>' || CAST(value AS VARCHAR) || '</td></tr>', '' ORDER BY obs_hour) || '</table>' AS html
    FROM h GROUP BY 1, 2
    """,
)
def html_fragment(spark, sf_dir):
    return _fragments(spark, sf_dir)


def _fragments(spark, sf_dir):
    # one reading per hour, so a station-day has at most 24 rows
    rows = events(spark, sf_dir).select(F.col("user_id").alias("station"), "ts", "event_id", "value")
    hourly = audit.hourly_series(rows, "station", "ts", "event_id", "value")
    shown = hourly.withColumns({"obs_date": F.to_date("obs_hour"), "clock": F.date_format("obs_hour", "HH:mm")})
    return tables.html_fragments(shown, ["station", "obs_date"], "obs_hour", ["clock", "value"])


@query(
    "table_rows",
    """
    WITH h AS (SELECT user_id AS station, date_trunc('hour', ts) AS obs_hour, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
    SELECT station, CAST(obs_hour AS DATE) AS obs_date, strftime(obs_hour, '%H:%M') AS clock, value,
           CAST(row_number() OVER (PARTITION BY station, CAST(obs_hour AS DATE) ORDER BY obs_hour) - 1 AS INTEGER) AS row_no FROM h
    """,
)
def table_rows(spark, sf_dir):
    # the page tables are the fragments of the readings, so taking them apart must give the readings back
    rows = pages.table_rows(_fragments(spark, sf_dir), "html", ["station", "obs_date"])
    cells = F.col("cells")
    return rows.select("station", "obs_date", cells[0].alias("clock"), number(cells[1]).alias("value"), "row_no")


@query(
    "station_directory",
    """
    SELECT upper(n_name) AS state, s_name AS name, 'S' || CAST(s_suppkey AS VARCHAR) || '.xml' AS xml
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def station_directory(spark, sf_dir):
    # one state page per supplier: a header row, the station's row with three links, and a row without
    key = F.col("s_suppkey").cast("string")
    cell = lambda href, label: F.concat(F.lit('<td><a href="'), href, F.lit('">'), label, F.lit("</a></td>"))
    page = F.concat(
        F.lit("<table><tr><th>Station</th></tr><tr>"), cell(F.concat(F.lit("rss/S"), key), F.col("s_name")),
        cell(F.concat(F.lit("S"), key, F.lit(".xml")), F.lit("XML")), cell(F.lit("rss.php"), F.lit("RSS")),
        F.lit("</tr><tr><td>end</td></tr></table>"),
    )
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    state_pages = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("state"), page.alias("html")
    )
    return pages.station_directory(state_pages, "html", "state").drop("links")


@query(
    "html_rows",
    """
    SELECT event_id, '<tr><td>' || event_type || '</td><td>' || CAST(value AS VARCHAR) || '</td><td>' || coalesce(nullif(user_id, 7)::VARCHAR, '&lt;no_value_provided&gt;') || '</td></tr>' AS html FROM events
    """,
)
def html_rows(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("gust", F.nullif("user_id", F.lit(7)))
    return tables.html_rows(rows, ["event_type", "value", "gust"]).select("event_id", "html")


@query(
    "xml_export",
    """
    SELECT event_id, '<current_observation><station_id>' || event_type || '</station_id>'
           || coalesce('<wind_mph>' || CAST(nullif(value, 0.01) AS VARCHAR) || '</wind_mph>', '')
           || '<observation_time>Last Updated on ' || strftime(ts, '%b %-d %Y, %-I:%M ') || lower(strftime(ts, '%p'))
           || ' EST</observation_time></current_observation>' AS xml FROM events
    """,
)
def xml_export(spark, sf_dir):
    return _xml_rows(spark, sf_dir).select("event_id", tables.xml_record(*_XML_FIELDS).alias("xml"))


_XML_FIELDS = ("station_id", "wind_mph", "observation_time")


def _xml_rows(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id", F.col("event_type").alias("station_id"), F.nullif("value", F.lit(0.01)).alias("wind_mph"), "ts",
        F.lit("EST").alias("tz_abbr"),
    )
    return rows.withColumn("observation_time", tables.update_text("ts", "tz_abbr"))


@query(
    "xml_parse",
    """
    SELECT event_id, event_type AS station_id, nullif(value, 0.01) AS wind_mph, date_trunc('minute', ts) AS obs_local FROM events
    """,
)
def xml_parse(spark, sf_dir):
    # exported records read back by field name; the removed value comes back as NULL
    records = observations.parse_xml(xml_export(spark, sf_dir), "xml", ["event_id"])
    local = parse_local_time("observation_time").alias("obs_local")
    return records.select("event_id", "station_id", number("wind_mph").alias("wind_mph"), local)


@query(
    "xml_broken",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' ELSE '<a' END AS payload FROM events WHERE event_id % 3 < 2",
)
def xml_broken(spark, sf_dir):
    """Payloads that are no record stay as flagged rows."""
    xml = F.expr("case event_id % 3 when 0 then null when 1 then '<a' else '<current_observation><station_id>K</station_id></current_observation>' end")
    records = observations.parse_xml(events(spark, sf_dir).select("event_id", xml.alias("xml")), "xml", ["event_id"])
    return records.where("_corrupt_record is not null").select("event_id", F.col("_corrupt_record").alias("payload"))


@query(
    "xml_files",
    """
    SELECT station_id, record, count(*) AS n_records FROM (SELECT event_type AS station_id,
           event_type || strftime(max(ts), '_Y%Y_M%m_D%d_H%H') AS record FROM events GROUP BY event_type, CAST(ts AS DATE)) GROUP BY 1, 2
    """,
)
def xml_files(spark, sf_dir):
    """The newest record of each station and day as a file of its own, read back by the XML source."""
    folder = fresh_folder(spark, "xml-files")
    rows = _xml_rows(spark, sf_dir).withColumn("obs_date", F.to_date("ts"))
    newest = latest_per_key(rows, ["station_id", "obs_date"], ["ts", "event_id"], ["ts", "wind_mph", "observation_time"])
    tables.write_xml_files(newest, folder, list(_XML_FIELDS), ts="ts")
    back = observations.read_xml(spark, folder)
    return back.groupBy("station_id", "record").agg(F.count(F.lit(1)).alias("n_records"))


@query(
    "split_json",
    """
    SELECT event_id, '["event_type","value","user_id"]' AS columns,
           '["' || event_type || '",' || coalesce(CAST(nullif(value, 0.01) AS VARCHAR), 'null') || ',' || CAST(user_id AS VARCHAR) || ']' AS data FROM events
    """,
)
def split_json(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("value", F.nullif("value", F.lit(0.01)))
    return tables.split_json(rows, ["event_type", "value", "user_id"]).select("event_id", "columns", "data")


@query(
    "split_json_objects",
    """
    WITH h AS (SELECT user_id AS station, date_trunc('hour', ts) AS obs_hour, arg_max(value, (ts, event_id)) AS value,
                      arg_max(nullif(event_type, 'error'), (ts, event_id)) FILTER (event_type <> 'error') AS kind FROM events GROUP BY 1, 2)
    SELECT station, CAST(obs_hour AS DATE) AS obs_date, '{"columns":["kind","value"],"index":['
           || string_agg('"' || strftime(obs_hour, '%H:%M') || '"', ',' ORDER BY obs_hour) || '],"data":['
           || string_agg('[' || coalesce('"' || kind || '"', 'null') || ',' || CAST(value AS VARCHAR) || ']', ',' ORDER BY obs_hour) || ']}' AS json
    FROM h GROUP BY 1, 2
    """,
)
def split_json_objects(spark, sf_dir):
    """One object per station and day of hourly rows."""
    rows = events(spark, sf_dir).select(
        F.col("user_id").alias("station"), hour_floor("ts").alias("obs_hour"), "ts", "event_id", "value",
        F.nullif("event_type", F.lit("error")).alias("kind"),
    )
    order = F.struct("ts", "event_id")
    hourly = rows.groupBy("station", "obs_hour").agg(
        F.max_by("value", order).alias("value"), F.max_by("kind", F.when(F.col("kind").isNotNull(), order)).alias("kind")
    )
    shown = hourly.withColumns({"obs_date": F.to_date("obs_hour"), "clock": F.date_format("obs_hour", "HH:mm")})
    return tables.split_json_objects(shown, ["station", "obs_date"], "clock", ["kind", "value"])


@query(
    "summary_json",
    """
    SELECT '{"station":"' || event_type || '","date":"' || strftime(CAST(ts AS DATE), '%Y-%m-%d') || '","polyfit":'
           || CASE WHEN count(value) > 1 THEN CAST(CAST(round(regr_slope(value, date_diff('microsecond', date_trunc('day', ts), ts) / 86400000000.0), 4)
                   AS DECIMAL(18, 4)) AS VARCHAR) ELSE '0.0000' END
           || ',"max":' || CAST(max(value) AS VARCHAR)
           || ',"min":' || CAST(min(value) AS VARCHAR) || '}' AS json FROM events GROUP BY event_type, CAST(ts AS DATE)
    """,
)
def summary_json(spark, sf_dir):
    days = summary.daily_summary(events(spark, sf_dir), "event_type", "ts", "value")
    fields = F.struct(
        "station",
        F.col("obs_date").alias("date"),
        F.col("slope").cast("decimal(18,4)").alias("polyfit"),
        F.col("max_value").alias("max"),
        F.col("min_value").alias("min"),
    )
    return days.select(F.to_json(fields).alias("json"))


# An invented record layout: attributes, a namespace, a nested element, an order of its own, fixed texts and empty elements.
TEMPLATE = """<?xml version="1.0" encoding="UTF-8"?>
<?xml-stylesheet href="reading.xsl" type="text/xsl"?>
<current_observation xmlns:geo="http://example.org/geo" version="2.0">
  <credit>Own &amp; invented</credit>
  <image>
    <url>http://example.org/</url>
    <title/>
  </image>
  <station_id>X</station_id>
  <wind_mph>0</wind_mph>
  <weather>none</weather>
  <geo:place kind="station">Y</geo:place>
</current_observation>
"""


@query(
    "xml_template",
    """
    WITH r AS (SELECT event_id, value, nullif(event_type, 'error') AS kind, 'U' || user_id AS station, nullif(user_id % 7, 0) AS place FROM events)
    SELECT event_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<?xml-stylesheet href="reading.xsl" type="text/xsl"?>' || chr(10)
        || '<current_observation xmlns:geo="http://example.org/geo" version="2.0">' || chr(10) || '  <credit>Own &amp; invented</credit>' || chr(10)
        || '  <image>' || chr(10) || '    <url>http://example.org/</url>' || chr(10) || '    <title>A &lt;' || kind || '&gt;</title>' || chr(10) || '  </image>' || chr(10)
        || '  <station_id>' || station || '</station_id>' || chr(10) || '  <wind_mph>' || CAST(value AS VARCHAR) || '</wind_mph>'
        || coalesce(chr(10) || '  <weather>' || kind || '</weather>', '')
        || coalesce(chr(10) || '  <geo:place kind="station">' || CAST(place AS VARCHAR) || '</geo:place>', '') || chr(10) || '</current_observation>' AS xml,
        station AS station_id, CAST(value AS VARCHAR) AS wind_mph, kind AS weather FROM r WHERE kind IS NOT NULL
    UNION ALL
    SELECT event_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<?xml-stylesheet href="reading.xsl" type="text/xsl"?>' || chr(10)
        || '<current_observation xmlns:geo="http://example.org/geo" version="2.0">' || chr(10) || '  <credit>Own &amp; invented</credit>' || chr(10)
        || '  <image>' || chr(10) || '    <url>http://example.org/</url>' || chr(10) || '  </image>' || chr(10)
        || '  <station_id>' || station || '</station_id>' || chr(10) || '  <wind_mph>' || CAST(value AS VARCHAR) || '</wind_mph>'
        || coalesce(chr(10) || '  <geo:place kind="station">' || CAST(place AS VARCHAR) || '</geo:place>', '') || chr(10) || '</current_observation>' AS xml,
        station, CAST(value AS VARCHAR), NULL FROM r WHERE kind IS NULL
    """,
)
def xml_template(spark, sf_dir):
    """Records written after a template, and the fields read back from what was written."""
    kind = F.nullif("event_type", F.lit("error"))
    rows = events(spark, sf_dir).select(
        "event_id", F.col("value").cast("string").alias("speed"), kind.alias("kind"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("station"),
        F.nullif(F.col("user_id") % 7, F.lit(0)).alias("place"),
    )
    columns = {"image/title": F.concat(F.lit("A <"), F.col("kind"), F.lit(">")), "station_id": "station", "wind_mph": "speed", "weather": "kind", "geo:place": "place"}
    written = rows.select("event_id", xmltemplate.compile_template(TEMPLATE, columns).alias("xml"))
    back = observations.parse_xml(written, "xml", ["event_id", "xml"])
    return back.select("event_id", "xml", "station_id", "wind_mph", "weather")


@query(
    "xml_extra_fields",
    """
    SELECT event_id, event_type AS station_id, CAST(value AS VARCHAR) AS wind_mph, user_id AS uv_index,
           CASE WHEN event_id % 5 <> 0 THEN event_type END AS road_state, CAST(NULL AS DOUBLE) AS absent,
           CASE WHEN event_id % 5 <> 0 THEN 2 ELSE 1 END AS n_extra FROM events
    """,
)
def xml_extra_fields(spark, sf_dir):
    """Records with tags outside the 43 fields: kept in one VARIANT column, then promoted to typed columns."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), F.col(c).cast("string"), F.lit(f"</{name}>"))
    road = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("<road><state>"), F.col("event_type"), F.lit("</state></road>"))).otherwise("")
    xml = F.concat(F.lit("<current_observation>"), tag("station_id", "event_type"), tag("uv_index", "user_id"), tag("wind_mph", "value"), road)
    rows = events(spark, sf_dir).select("event_id", F.concat(xml, F.lit("</current_observation>")).alias("xml"))
    kept = extra.promoted(extra.parse_xml_with_extra(rows, "xml", ["event_id"]), {"uv_index": "bigint", "road": "variant", "absent": "double"})
    state = F.try_variant_get("road", "$.state", "string")
    n_extra = F.size(F.map_keys(F.col(extra.EXTRA).cast("map<string, variant>")))
    return kept.select("event_id", "station_id", "wind_mph", "uv_index", state.alias("road_state"), "absent", n_extra.alias("n_extra"))
