"""Time, unit and text functions over whole tables."""

from pyspark.sql import functions as F

from gustline.functions import text as X
from gustline.functions import times as T
from gustline.functions import units as U
from gustline.plans.registry import events, query, table


@query(
    "time_formats",
    """
    SELECT event_id, strftime(ts, '%a, %b %d %Y %-H:%M:%S') || ' -0500' AS rfc,
           strftime(ts, '%b %d %Y, %-I:%M:%S ') || lower(strftime(ts, '%p')) || ' EST' AS reg,
           strftime(ts, '%m/%d/%y %H:%M:%S') AS excel, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt FROM events
    """,
)
def time_formats(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        T.emit_time("ts", "rfc", F.lit(-300)).alias("rfc"),
        T.emit_time("ts", "reg", zone=F.lit("EST")).alias("reg"),
        T.emit_time("ts", "excel").alias("excel"),
        T.emit_time("ts", "dt").alias("dt"),
    )


@query(
    "time_parse",
    """
    SELECT event_id, CASE user_id % 3 WHEN 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS local_time,
           CASE user_id % 3 WHEN 0 THEN 'HST' END AS zone, CASE user_id % 3 WHEN 1 THEN -600 END AS offset_minutes,
           CASE user_id % 3 WHEN 1 THEN date_trunc('second', ts) + INTERVAL 10 HOUR END AS utc_time FROM events
    """,
)
def time_parse(spark, sf_dir):
    # each row's time is written in one of the three accepted forms, so that parsing must give it back
    local = F.concat(F.date_format("ts", "'Last Updated on 'MMM d yyyy, h:mm "), F.lower(F.date_format("ts", "a")), F.lit(" HST"))
    rfc = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -1000"))
    form = F.col("user_id") % 3
    text = F.when(form == 0, local).when(form == 1, rfc).otherwise(T.emit_time("ts", "excel"))
    return events(spark, sf_dir).select("event_id", text.alias("text")).select(
        "event_id",
        T.parse_time("text").alias("local_time"),
        T.zone_abbreviation("text").alias("zone"),
        T.rfc_offset_minutes("text").alias("offset_minutes"),
        T.utc_clock(T.parse_rfc_time("text")).alias("utc_time"),
    )


@query(
    "calendar_fields",
    """
    SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
           CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(date_trunc('day', ts) AS TIMESTAMP) AS midnight,
           CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS seconds_of_day FROM events
    """,
)
def calendar_fields(spark, sf_dir):
    fields = T.calendar_fields("ts")
    return events(spark, sf_dir).select("event_id", *[c.alias(name) for name, c in fields.items()])


@query(
    "hour_arithmetic",
    """
    SELECT event_id, ts + INTERVAL 1 HOUR AS plus_one, ts - INTERVAL 26 HOUR AS minus_many,
           round(date_diff('microsecond', date_trunc('day', ts), ts) / 3600000000.0, 6) AS hours_of_day FROM events
    """,
)
def hour_arithmetic(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        (F.col("ts") + T.hours(1)).alias("plus_one"),
        (F.col("ts") + T.hours(-26)).alias("minus_many"),
        F.round(T.hour_diff("ts", T.day_floor("ts")), 6).alias("hours_of_day"),
    )


@query(
    "local_clock",
    """
    SELECT event_id, ts + ((user_id % 24) - 12) * INTERVAL 1 HOUR AS local_now FROM events
    """,
)
def local_clock(spark, sf_dir):
    offset = (F.col("user_id") % 24 - 12) * 60
    instant = F.timestamp_micros(T.wall_micros("ts"))
    return events(spark, sf_dir).select("event_id", T.local_now(offset, instant).alias("local_now"))


@query(
    "future_flag",
    """
    SELECT event_id, ts > ts + (event_id % 6 - 3) * INTERVAL 30 MINUTE + INTERVAL 1 HOUR AS is_future FROM events
    """,
)
def future_flag(spark, sf_dir):
    other = F.col("ts") + F.make_dt_interval(mins=((F.col("event_id") % 6 - 3) * 30).cast("int"))
    return events(spark, sf_dir).select("event_id", T.is_future("ts", other).alias("is_future"))


@query(
    "zone_offsets",
    """
    SELECT event_id, CASE user_id % 3 WHEN 0 THEN CAST(user_id % 13 * 60 + 30 AS INTEGER) WHEN 1 THEN CAST(-(user_id % 13) * 60 AS INTEGER) END AS offset_minutes
    FROM events
    """,
)
def zone_offsets(spark, sf_dir):
    hh = F.lpad((F.col("user_id") % 13).cast("string"), 2, "0")
    form = F.col("user_id") % 3
    text = F.when(form == 0, F.concat(F.lit("UTC+"), hh, F.lit(":30"))).when(form == 1, F.concat(F.lit("UTC-"), hh))
    text = text.otherwise(F.concat(F.lit("UTC+"), hh, F.lit("/UTC+"), hh))
    return events(spark, sf_dir).select("event_id", T.utc_offset_minutes(text).alias("offset_minutes"))


@query(
    "month_span",
    """
    SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
           CAST(abs((year(min(o_orderdate)) - year(max(o_orderdate))) * 12 + month(min(o_orderdate)) - month(max(o_orderdate))) AS INTEGER) AS n_months
    FROM orders GROUP BY 1
    """,
)
def month_span(spark, sf_dir):
    span = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day")
    )
    return span.withColumn("n_months", T.month_distance("first_day", "last_day"))


@query(
    "month_sequence",
    """
    WITH s AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
    SELECT o_custkey, CAST(m.x AS DATE) AS month_start FROM s, LATERAL (SELECT unnest(generate_series(
           CAST(date_trunc('month', a) AS TIMESTAMP), CAST(date_trunc('month', b) AS TIMESTAMP), INTERVAL 1 MONTH)) AS x) m
    """,
)
def month_sequence(spark, sf_dir):
    span = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")
    )
    return span.select("o_custkey", F.explode(T.month_starts("a", "b")).alias("month_start"))


@query(
    "date_coercion",
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_slashes, CAST(o_orderdate AS DATE) AS from_us,
           CAST(o_orderdate AS DATE) AS from_words, CAST(o_orderdate AS DATE) AS from_comma, CAST(o_orderdate AS DATE) AS from_long,
           CAST(o_orderdate AS DATE) AS from_day_first, CAST(o_orderdate AS DATE) AS from_short, CAST(o_orderdate AS DATE) AS from_dashes,
           CAST(o_orderdate AS DATE) AS from_iso_time, CAST(o_orderdate AS DATE) AS from_ordinal,
           CAST(o_orderdate AS DATE) AS from_weekday, CAST(o_orderdate AS DATE) AS from_rfc, CAST(o_orderdate AS DATE) AS from_dots,
           CAST(o_orderdate AS DATE) AS from_dots_iso, CAST(date_trunc('month', o_orderdate) AS DATE) AS from_month,
           CAST(o_orderdate AS DATE) AS from_compact, CAST(o_orderdate AS DATE) AS from_pm,
           CASE WHEN day(o_orderdate) > 12 THEN CAST(o_orderdate AS DATE)
                ELSE make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END AS from_day_month,
           CAST(month(o_orderdate) AS INTEGER) AS month_num, CAST(NULL AS DATE) AS from_junk FROM orders
    """,
)
def date_coercion(spark, sf_dir):
    day = F.col("o_orderdate")
    # parsing costs far more than a shuffle of three columns, and a file of one row group would be one task
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return orders.repartition(4 * spark.sparkContext.defaultParallelism).select(
        "o_orderkey",
        T.parse_date(F.date_format(day, "yyyy/M/d")).alias("from_slashes"),
        T.parse_date(F.date_format(day, "MM/dd/yyyy")).alias("from_us"),
        T.parse_date(F.date_format(day, "d MMM yyyy")).alias("from_words"),
        T.parse_date(F.date_format(day, "MMM d, yyyy")).alias("from_comma"),
        T.parse_date(F.date_format(day, "MMMM d, yyyy")).alias("from_long"),
        T.parse_date(F.date_format(day, "d MMMM yyyy")).alias("from_day_first"),
        T.parse_date(F.date_format(day, "M/d/yy")).alias("from_short"),
        T.parse_date(F.date_format(day, "MM-dd-yyyy")).alias("from_dashes"),
        T.parse_date(F.date_format(day, "yyyy-MM-dd'T10:00'")).alias("from_iso_time"),
        T.parse_date(F.concat(F.upper(F.date_format(day, "MMM ")), F.dayofmonth(day).cast("string"), F.lit("th "), F.date_format(day, "yyyy"))).alias("from_ordinal"),
        T.parse_date(F.date_format(day, "EEEE, MMMM d, yyyy")).alias("from_weekday"),
        T.parse_date(F.date_format(day, "EEE, dd MMM yyyy '08:52:00 -0500'")).alias("from_rfc"),
        T.parse_date(F.when(F.dayofmonth(day) > 12, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MM.dd.yyyy"))).alias("from_dots"),
        T.parse_date(F.date_format(day, "yyyy.MM.dd")).alias("from_dots_iso"),
        T.parse_date(F.date_format(day, "MMM yyyy")).alias("from_month"),
        T.parse_date(F.date_format(day, "yyyyMMdd'T1200'")).alias("from_compact"),
        T.parse_date(F.date_format(day, "yyyy-MM-dd '8pm'")).alias("from_pm"),
        # day first only where the number can be no month
        T.parse_date(F.date_format(day, "dd/MM/yyyy")).alias("from_day_month"),
        T.month_number(F.date_format(day, "MMMM")).alias("month_num"),
        T.parse_date("o_orderpriority").alias("from_junk"),
    )


@query(
    "file_key",
    """
    SELECT event_id, event_type || strftime(ts, '_Y%Y_M%m_D%d_H%H') || '.csv' AS day_file,
           event_type || strftime(ts, '_Y%Y_M%m_D01_H00') || '_Monthly.csv' AS month_file,
           event_type || strftime(ts, '_Y%Y_M01_D01_H00') || '_Yearly.csv' AS year_file,
           event_type || strftime(ts, '_Y%Y_M%m_D%d_H%H') || '_Range40.csv' AS range_file,
           CAST(ts AS DATE) AS file_date FROM events
    """,
)
def file_key(spark, sf_dir):
    day_file = T.file_key("event_type", "ts")
    return events(spark, sf_dir).select(
        "event_id",
        day_file.alias("day_file"),
        T.month_file_key("event_type", "ts").alias("month_file"),
        T.year_file_key("event_type", "ts").alias("year_file"),
        T.range_file_key("event_type", "ts", F.date_add(F.to_date("ts"), 40)).alias("range_file"),
        T.date_of_file(day_file).alias("file_date"),
    )


@query(
    "unit_convert",
    """
    SELECT event_id, round(value * 0.868976, 6) AS knots, round((value - 32) * 0.5556, 6) AS celsius FROM events
    """,
)
def unit_convert(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", F.round(U.knots("value"), 6).alias("knots"), F.round(U.celsius("value"), 6).alias("celsius")
    )


_POINT = "CASE user_id % 9 WHEN 0 THEN 'n' WHEN 1 THEN 'NE' WHEN 2 THEN 'East' WHEN 3 THEN 'SouthEast' WHEN 4 THEN 's' WHEN 5 THEN 'SW' WHEN 6 THEN 'west' WHEN 7 THEN 'NorthWest' ELSE 'bat' END"


@query(
    "code_map",
    """
    SELECT event_id, CASE user_id % 9 WHEN 8 THEN -1 ELSE CAST(user_id % 9 * 45 AS INTEGER) END AS degrees,
           CASE user_id % 9 WHEN 0 THEN 'North' WHEN 1 THEN 'NorthEast' WHEN 2 THEN 'East' WHEN 3 THEN 'SouthEast' WHEN 4 THEN 'South'
                WHEN 5 THEN 'SouthWest' WHEN 6 THEN 'West' WHEN 7 THEN 'NorthWest' END AS direction FROM events
    """,
)
def code_map(spark, sf_dir):
    point = F.expr(_POINT)
    return events(spark, sf_dir).select(
        "event_id", U.compass_degrees(point).alias("degrees"), U.compass_text(point).alias("direction")
    )


# Wind text of a reading: calm, variable, plain or gusty by its user.
_WIND = """CASE user_id % 4 WHEN 0 THEN 'Calm' WHEN 1 THEN concat('Vrbl ', cast(cast(value as int) as string))
           WHEN 2 THEN concat('NE ', cast(cast(value as int) as string))
           ELSE concat('SW ', cast(cast(value as int) as string), ' G ', cast(cast(value as int) + 10 as string)) END"""


@query(
    "token_parse",
    """
    SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'North' WHEN 1 THEN 'Variable' WHEN 2 THEN 'NorthEast' ELSE 'SouthWest' END AS direction,
           CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN 45 ELSE 225 END AS degrees,
           CASE user_id % 4 WHEN 0 THEN 0.0 ELSE trunc(value) END AS mph,
           CASE user_id % 4 WHEN 3 THEN trunc(value) + 10 END AS gust_mph,
           user_id % 4 = 0 AS calm, user_id % 4 = 1 AS variable FROM events
    """,
)
def token_parse(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", U.wind_parts(F.expr(_WIND)).alias("w"))
    return rows.select("event_id", *[f"w.{c}" for c in ("direction", "degrees", "mph", "gust_mph", "calm", "variable")])


@query(
    "display_string",
    """
    SELECT event_id,
           CASE WHEN user_id % 2 = 0 THEN 'North at ' || CAST(round(value, 1) AS VARCHAR) || ' MPH (' || CAST(round(value, 1) * 0.868976 AS VARCHAR) || ' KT)'
                ELSE 'from the North at ' || CAST(round(value, 1) AS VARCHAR) || ' gusting to ' || CAST(round(value, 1) + 4 AS VARCHAR) || ' MPH ('
                     || CAST(round(value, 1) * 0.868976 AS VARCHAR) || ' KT gusting to ' || CAST((round(value, 1) + 4) * 0.868976 AS VARCHAR) || ' KT)' END AS wind,
           CAST(round(value, 1) AS VARCHAR) || ' F (' || CAST((round(value, 1) - 32) * 0.5556 AS VARCHAR) || ' C)' AS temperature,
           CAST(value AS VARCHAR) || ' mb' AS pressure, CAST(NULL AS VARCHAR) AS missing FROM events
    """,
)
def display_string(spark, sf_dir):
    reading = F.round("value", 1)
    gust = F.when(F.col("user_id") % 2 == 1, reading + 4)
    return events(spark, sf_dir).select(
        "event_id",
        U.wind_display(F.lit("North"), reading, gust).alias("wind"),
        U.temperature_display(reading).alias("temperature"),
        U.pressure_display("value").alias("pressure"),
        U.temperature_display(F.lit(None).cast("double")).alias("missing"),
    )


@query(
    "url_key",
    """
    SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host,
           CASE WHEN page_id % 2 = 0 THEN 'K' || upper(lpad(substr(md5(url), 1, 3), 3, '0')) END AS station FROM pages
    """,
)
def url_key(spark, sf_dir):
    # half of the pages get a station file behind their host, the others keep another shape
    key = F.concat(F.lit("K"), F.substring(F.md5("url"), 1, 3))
    feed = F.concat(F.lit("https://"), F.regexp_extract("url", "^https?://([^/:]+)", 1), F.lit("/current_obs/"), key)
    feed = F.concat(feed, F.when(F.col("page_id") % 2 == 0, ".xml").otherwise(".html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"), X.station_of_url(feed).alias("station")
    )


@query(
    "prefix_strip",
    r"""
    SELECT doc_id, md5(rtrim(regexp_replace(text, '^\s+', ''), ' ')) AS stripped_md5, md5(text) AS text_md5 FROM documents
    """,
)
def prefix_strip(spark, sf_dir):
    dated = X.strip_update_prefix(F.concat(F.lit("Last Updated on "), "text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.fingerprint(dated).alias("stripped_md5"), X.fingerprint("text").alias("text_md5")
    )
