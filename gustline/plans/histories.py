"""Combining, splitting and slicing history; filters on single readings."""

from datetime import date

from pyspark.sql import functions as F

from gustline.functions.times import hours, month_file_key, range_file_key, year_file_key
from gustline.functions.units import number
from gustline.operators import project, quality
from gustline.plans.registry import events, query, table
from gustline.session import fresh_folder
from gustline.sinks import tables
from gustline.sources import observations

START, END = date(1996, 12, 15), date(1997, 3, 2)
SLICE_DAY, SLICE_END = date(2024, 1, 10), date(2024, 1, 12)


@query(
    "combine_range",
    f"""
    SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, 'ship_Y1996_M12_D15_H00_Range77.csv' AS out_file
    FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'
    """,
)
def combine_range(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    start, end = F.lit(START), F.lit(END)
    name = range_file_key(F.lit("ship"), start.cast("timestamp_ntz"), end)
    return quality.date_range(lines, "l_shipdate", start, end).withColumn("out_file", name)


@query(
    "combine_month",
    """
    SELECT o_orderkey, o_custkey, o_orderdate, 'orders_Y1997_M02_D01_H00_Monthly.csv' AS out_file FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1997-03-01'
    """,
)
def combine_month(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    name = month_file_key(F.lit("orders"), F.lit(date(1997, 2, 1)))
    return quality.period(orders, "o_orderdate", 1997, 2).withColumn("out_file", name)


@query(
    "combine_year",
    """
    SELECT o_orderkey, o_custkey, o_orderdate, 'orders_Y1998_M01_D01_H00_Yearly.csv' AS out_file FROM orders
    WHERE year(o_orderdate) = 1998
    """,
)
def combine_year(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    name = year_file_key(F.lit("orders"), F.lit(date(1998, 1, 1)))
    return quality.period(orders, "o_orderdate", 1998).withColumn("out_file", name)


@query(
    "split_day_manifest",
    """
    SELECT l_shipmode AS station, obs_date, n_rows, l_shipmode || strftime(obs_date, '_Y%Y_M%m_D%d_H00') || '.csv' AS file_name
    FROM (SELECT 'S' || CAST(l_suppkey % 7 AS VARCHAR) AS l_shipmode, CAST(l_shipdate AS DATE) AS obs_date, count(*) AS n_rows
          FROM lineitem GROUP BY 1, 2)
    """,
)
def split_day_manifest(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")).alias("ship_station"), "l_shipdate"
    )
    return tables.split_manifest(lines, "ship_station", "l_shipdate")


@query(
    "date_slice",
    f"""
    SELECT event_id, ts, value FROM events
    WHERE ts >= TIMESTAMP '{SLICE_DAY}' AND ts < TIMESTAMP '{SLICE_DAY}' + INTERVAL 4 DAY
    """,
)
def date_slice(spark, sf_dir):
    return quality.coming_hours(events(spark, sf_dir).select("event_id", "ts", "value"), "ts", F.lit(SLICE_DAY), 72)


@query(
    "union_history",
    """
    SELECT o_custkey AS station, o_orderdate AS ts, o_totalprice AS reading, o_orderpriority AS note FROM orders
    UNION ALL SELECT user_id, ts, value, NULL FROM events
    UNION ALL SELECT l_suppkey, l_shipdate, l_extendedprice, NULL FROM lineitem
    """,
)
def union_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as station", "o_orderdate as ts", "o_totalprice as reading", "o_orderpriority as note"
    )
    readings = events(spark, sf_dir).selectExpr("user_id as station", "ts", "value as reading")
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as station", "l_shipdate as ts", "l_extendedprice as reading")
    return orders.unionByName(readings, allowMissingColumns=True).unionByName(lines, allowMissingColumns=True)


@query(
    "station_filter",
    "SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'",
)
def station_filter(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("event_type") == "click").select("event_id", "user_id", "ts", "value")


@query(
    "stale_filter",
    """
    SELECT event_id, ts FROM events
    WHERE CAST(ts AS DATE) = CAST(ts + (event_id % 6) * INTERVAL 1 HOUR AS DATE) OR hour(ts) = 23
    """,
)
def stale_filter(spark, sf_dir):
    local_now = F.col("ts") + hours(F.col("event_id") % 6)
    return events(spark, sf_dir).select("event_id", "ts").where(quality.is_current(F.col("ts"), local_now))


@query(
    "late_filter",
    """
    SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) >= CAST(DATE '2024-01-01' + CAST(event_id % 30 AS INTEGER) AS DATE)
    """,
)
def late_filter(spark, sf_dir):
    batch_date = F.date_add(F.lit(date(2024, 1, 1)), (F.col("event_id") % 30).cast("int"))
    return events(spark, sf_dir).select("event_id", "ts").where(quality.not_before_batch(F.col("ts"), batch_date))


@query(
    "sanity_split",
    """
    SELECT event_id, nullif(event_type, 'error') IS NULL OR nullif(user_id, 7) IS NULL AS is_suspect FROM events
    """,
)
def sanity_split(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("wind_dir"), F.nullif("user_id", F.lit(7)).alias("wind_mph")
    )
    flagged, _ = quality.sanity_split(rows, ("wind_dir", "wind_mph"))
    return flagged.select("event_id", "is_suspect")


@query(
    "quarantine_rows",
    "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' OR user_id = 7",
)
def quarantine_rows(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id", "ts", "user_id", F.nullif("event_type", F.lit("error")).alias("wind_dir"), F.nullif("user_id", F.lit(7)).alias("wind_mph")
    )
    _, suspect = quality.sanity_split(rows, ("wind_dir", "wind_mph"))
    return suspect.select("event_id", "ts", "user_id")


@query(
    "drop_missing",
    "SELECT event_id, value FROM (SELECT event_id, nullif(value, 0.01) AS value FROM events) WHERE value IS NOT NULL",
)
def drop_missing(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.nullif("value", F.lit(0.01)).alias("value"))
    return rows.na.drop(subset=["value"])


@query(
    "derived_files",
    """
    SELECT doc_id, source AS name FROM documents WHERE doc_id % 5 = 0
    """,
)
def derived_files(spark, sf_dir):
    # four of five documents are named like a derived copy
    suffixes = F.array(*[F.lit(s) for s in ("", "_Range3", "_Monthly", "_Yearly", "_latest")])
    name = F.concat("source", F.element_at(suffixes, (F.col("doc_id") % 5 + 1).cast("int")))
    return quality.original_files(table(spark, sf_dir, "documents").select("doc_id", name.alias("name")), "name")


_SPLIT_SQL = """
    SELECT event_type AS station_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           CAST(day(ts) AS INTEGER) AS day, event_id, value FROM events
    """


@query("split_days", _SPLIT_SQL)
def split_days(spark, sf_dir):
    folder = fresh_folder(spark, "split-days")
    rows = events(spark, sf_dir).select(F.col("event_type").alias("station_id"), "ts", "event_id", "value")
    tables.split_days(rows, folder, "ts")
    return spark.read.parquet(folder).select("station_id", "year", "month", "day", "event_id", "value")


@query(
    "table_range",
    f"""
    SELECT event_id, event_type AS station_id, CAST(ts AS DATE) AS obs_date, value FROM events
    WHERE CAST(ts AS DATE) BETWEEN DATE '{SLICE_DAY}' AND DATE '{SLICE_END}'
    """,
)
def table_range(spark, sf_dir):
    folder = fresh_folder(spark, "observations")
    rows = events(spark, sf_dir).select(F.col("event_type").alias("station_id"), "ts", "event_id", "value")
    tables.append_observations(rows, folder, "ts")
    in_range = observations.read_table_range(spark, folder, SLICE_DAY, SLICE_END)
    return in_range.select("event_id", "station_id", "obs_date", "value")


@query(
    "csv_files",
    "SELECT event_id, nullif(value, 0.01) AS value, event_type FROM events",
)
def csv_files(spark, sf_dir):
    folder = fresh_folder(spark, "csv-files")
    rows = events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("station_id"),
        F.nullif("value", F.lit(0.01)).cast("string").alias("wind_mph"),
        F.col("event_type").alias("wind_dir"),
    )
    tables.write_csv(project.canonical(rows), folder)
    back = observations.read_csv(spark, folder, multiline=False)
    return back.select(
        F.col("station_id").cast("bigint").alias("event_id"), number("wind_mph").alias("value"), F.col("wind_dir").alias("event_type")
    )
