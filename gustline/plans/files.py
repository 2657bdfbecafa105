"""Sources and sinks over files made from the given tables, written and read back."""

from datetime import date

from pyspark.sql import functions as F

from gustline.functions.times import day_file_key, file_key
from gustline.functions.units import number
from gustline.operators import project
from gustline.operators.ordered import ordered
from gustline.operators.quality import original_files
from gustline.plans.audits import ARRIVAL, ARRIVAL_SQL
from gustline.plans.registry import events, query, table
from gustline.session import fresh_folder
from gustline.sinks import tables
from gustline.sinks.tables import write_named_files
from gustline.sources import observations, textfiles


@query("tracker_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS wind_type, CAST(value AS VARCHAR) AS wind_speed_mph FROM events")
def tracker_csv(spark, sf_dir):
    """A tracker file whose header cells hold blanks; all its columns are text."""
    folder = fresh_folder(spark, "tracker")
    rows = events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("wind type"),
        F.col("value").cast("string").alias(" wind speed mph "),
    )
    rows.write.option("header", True).csv(folder)
    return textfiles.read_tracker(spark, folder).select("event_id", "wind_type", "wind_speed_mph")


@query(
    "station_list",
    """
    SELECT 'https://stations.example.org/observations/current/v2/region/' || CAST(s_nationkey AS VARCHAR) || '/S' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || '.xml' AS url,
           'S' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS station_id FROM supplier
    """,
)
def station_list(spark, sf_dir):
    """URLs of any length, with blanks around them and empty lines between."""
    folder = fresh_folder(spark, "station-list")
    station = F.concat(F.lit("S"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"))
    url = F.concat(
        F.lit("  https://stations.example.org/observations/current/v2/region/"), F.col("s_nationkey").cast("string"), F.lit("/"),
        station, F.lit(".xml \n"),
    )
    table(spark, sf_dir, "supplier").select(url.alias("value")).write.text(folder)
    return textfiles.read_station_list(spark, folder)


@query(
    "zone_file",
    """
    SELECT 'Z' || CAST(n_nationkey AS VARCHAR) AS abbr, n_name AS name,
           CASE n_nationkey % 3 WHEN 0 THEN 'UTC+' || lpad(CAST(n_nationkey % 12 AS VARCHAR), 2, '0') WHEN 1 THEN 'UTC-' || lpad(CAST(n_nationkey % 12 AS VARCHAR), 2, '0') || ':30'
                ELSE 'UTC+10/UTC+11' END AS utc_offset,
           CAST(CASE n_nationkey % 3 WHEN 0 THEN n_nationkey % 12 * 60 WHEN 1 THEN -(n_nationkey % 12 * 60 + 30) END AS INTEGER) AS offset_minutes FROM nation
    """,
)
def zone_file(spark, sf_dir):
    folder = fresh_folder(spark, "zones")
    key = F.col("n_nationkey")
    hour = F.lpad((key % 12).cast("string"), 2, "0")
    offset = F.when(key % 3 == 0, F.concat(F.lit("UTC+"), hour)).when(key % 3 == 1, F.concat(F.lit("UTC-"), hour, F.lit(":30")))
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Z"), key.cast("string")).alias("abbr"), F.col("n_name").alias("name"),
        offset.otherwise("UTC+10/UTC+11").alias("utc_offset"),
    )
    rows.write.option("header", True).csv(folder)
    return textfiles.read_zones(spark, folder).drop("line_no")


def _record(rows):
    return project.canonical(rows.select(
        F.col("event_id").cast("string").alias("station_id"), F.col("event_type").alias("wind_dir"), F.col("value").cast("string").alias("wind_mph")
    ))


@query(
    "guarded_write",
    "SELECT event_id, value FROM events",
)
def guarded_write(spark, sf_dir):
    """A second write of other values without ``force`` leaves the first output as it is."""
    folder = fresh_folder(spark, "guarded")
    rows = events(spark, sf_dir)
    tables.guarded_write(_record(rows), folder)
    tables.guarded_write(_record(rows.withColumn("value", F.col("value") + 1)), folder)
    back = observations.read_csv(spark, folder, multiline=False)
    return back.select(F.col("station_id").cast("bigint").alias("event_id"), number("wind_mph").alias("value"))


@query("combined_file", "SELECT event_id, value, event_type FROM events")
def combined_file(spark, sf_dir):
    """The combining sink: one global order over several files, forced over an older output."""
    folder = fresh_folder(spark, "combined")
    rows = events(spark, sf_dir)
    tables.combine(_record(rows.where("event_id % 2 = 0")), folder, ["station_id"])
    tables.combine(_record(rows), folder, ["station_id"], force=True)
    back = observations.read_csv(spark, folder, multiline=False)
    return back.select(
        F.col("station_id").cast("bigint").alias("event_id"), number("wind_mph").alias("value"), F.col("wind_dir").alias("event_type")
    )


@query(
    "latest_snapshot",
    "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
)
def latest_snapshot(spark, sf_dir):
    folder = fresh_folder(spark, "latest")
    tables.write_latest(events(spark, sf_dir), folder, ["user_id"], ["ts", "event_id"], ["ts", "event_id"])
    return spark.read.parquet(folder).select("user_id", "ts", "event_id")


@query("append_twice", "SELECT event_id, event_type AS station_id, CAST(ts AS DATE) AS obs_date FROM events")
def append_twice(spark, sf_dir):
    """Two snapshots appended to the table partitioned by day."""
    folder = fresh_folder(spark, "appended")
    rows = events(spark, sf_dir).select(F.col("event_type").alias("station_id"), "ts", "event_id", "value")
    for part in (0, 1):
        tables.append_observations(rows.where(F.col("event_id") % 2 == part), folder, "ts")
    return spark.read.parquet(folder).select("event_id", "station_id", "obs_date")


_MINUTE = "date_trunc('minute', ts)"


@query(
    "late_merge",
    f"""
    WITH a AS (SELECT event_id, CAST(user_id AS VARCHAR) AS station_id, {_MINUTE} AS obs_local, value, {ARRIVAL_SQL} AS arrival FROM events),
         r AS (SELECT *, row_number() OVER (PARTITION BY station_id, obs_local ORDER BY arrival, event_id) AS rn FROM a)
    SELECT station_id, obs_local, event_id, value, arrival, CAST(obs_local AS DATE) AS obs_date FROM r WHERE rn = 1
    """,
)
def late_merge(spark, sf_dir):
    """The tenth of the rows that came last merged into a table of all others, twice: as if all had been ingested in order."""
    folder = fresh_folder(spark, "merged")
    rows = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("station_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("obs_local"), "event_id",
        "value", F.expr(ARRIVAL).alias("arrival"),
    )
    is_late = F.expr("arrival * 10 div 1000003 = 9")
    tables.merge_late(rows.where(~is_late), folder, ["arrival", "event_id"])
    for _ in range(2):
        tables.merge_late(rows.where(is_late), folder, ["arrival", "event_id"])
    return spark.read.parquet(folder).select("station_id", "obs_local", "event_id", "value", "arrival", "obs_date")


@query(
    "station_blobs",
    """
    SELECT event_type || strftime(obs_date, '_Y%Y_M%m_D%d_H00') || '.txt' AS file_name, event_type AS station, md5(body) AS md5, CAST(length(body) AS BIGINT) AS length
    FROM (SELECT event_type, CAST(ts AS DATE) AS obs_date, count(*) || ' readings, last ' || max(event_id) || chr(10) AS body FROM events GROUP BY 1, 2)
    """,
)
def station_blobs(spark, sf_dir):
    """One bulletin file per station and day, and a copy of the newest; files come back with their MD5, the copy does not."""
    folder = fresh_folder(spark, "blobs")
    days = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("obs_date")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    body = F.concat(F.col("n").cast("string"), F.lit(" readings, last "), F.col("last").cast("string"))
    named = days.select(day_file_key("event_type", "obs_date", "txt").alias("name"), body.alias("body"))
    newest = days.groupBy("event_type").agg(F.max("obs_date").alias("obs_date"))
    copies = newest.select(F.concat("event_type", F.lit("_latest.txt")).alias("name"), F.lit("copy").alias("body"))
    write_named_files(named.unionByName(copies), folder, "name", "body")
    return textfiles.read_blobs(spark, folder, "*.txt", by_folder=True)


@query(
    "file_listing",
    """
    SELECT event_type || strftime(date_trunc('hour', ts), '_Y%Y_M%m_D%d_H%H') || '.csv' AS file_name, CAST(ts AS DATE) AS file_date
    FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1, 2
    """,
)
def file_listing(spark, sf_dir):
    """Files of one station chosen by name and by the date in it; files of other stations and combined copies lie beside them."""
    folder = fresh_folder(spark, "listing")
    rows = events(spark, sf_dir).groupBy(file_key("event_type", "ts").alias("name")).agg(F.count("*").cast("string").alias("body"))
    combined = rows.select(F.regexp_replace("name", r"\.csv$", "_Range7.csv").alias("name"), "body")
    write_named_files(rows.unionByName(combined), folder, "name", "body")
    first, last = date(2024, 1, 10), date(2024, 1, 20)
    found = observations.list_files(spark, folder, observations.range_glob("error", first, last), by_folder=True)
    return original_files(found, "file_name").where(F.col("file_date").between(first, last)).select("file_name", "file_date")


@query(
    "collection_time",
    "SELECT event_id, TIMESTAMP '2024-02-01 00:20:00' AS collection_time, CAST(datediff('minute', ts, TIMESTAMP '2024-02-01 00:20:00') AS BIGINT) AS age_minutes FROM events",
)
def collection_time(spark, sf_dir):
    """Each reading with the time of its collection, and its age then in minute ends passed."""
    rows = project.with_collection_time(events(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-02-01 00:20:00")))
    minutes = F.timestamp_diff("MINUTE", F.date_trunc("minute", "ts").cast("timestamp_ntz"), F.col("collection_time"))
    return rows.select("event_id", "collection_time", minutes.alias("age_minutes"))


@query(
    "sorted_names",
    """
    SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS BIGINT) AS place FROM customer
    """,
)
def sorted_names(spark, sf_dir):
    """Stations by name, numbered over as many files as they need: places inside a slice plus the rows of the slices before it."""
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(1).alias("one"))
    placed = ordered(names, ["one"], ["c_name", "c_custkey"]).running_sum("place", F.lit(1)).done()
    return placed.orderBy("c_name", "c_custkey").select("c_custkey", "c_name", "place")
