"""Daily summary, profiles and top lists."""

from datetime import date

from pyspark.sql import functions as F

from gustline.functions.units import number
from gustline.operators import audit, dedup, sketches, summary, trend
from gustline.plans.registry import events, query, table
from gustline.session import fresh_folder


@query(
    "daily_summary",
    """
    SELECT event_type AS station, CAST(ts AS DATE) AS obs_date, max(value) AS max_value, min(value) AS min_value,
           count(value) AS n_obs,
           CASE WHEN count(value) > 1
                THEN round(regr_slope(value, date_diff('microsecond', date_trunc('day', ts), ts) / 86400000000.0), 4)
                ELSE 0.0 END AS slope
    FROM events WHERE value IS NOT NULL GROUP BY 1, 2
    """,
)
def daily_summary(spark, sf_dir):
    return summary.daily_summary(events(spark, sf_dir), "event_type", "ts", "value")


@query(
    "day_completeness",
    """
    SELECT event_type AS station, CAST(ts AS DATE) AS obs_date, count(*) AS n_rows,
           count(DISTINCT date_trunc('hour', ts)) AS n_hours,
           count(DISTINCT date_trunc('hour', ts)) < 24 AS is_short
    FROM events GROUP BY 1, 2
    """,
)
def day_completeness(spark, sf_dir):
    return audit.day_completeness(events(spark, sf_dir).withColumnRenamed("event_type", "station"), "station", "ts")


@query(
    "distinct_profile",
    """
    SELECT user_id AS station, count(DISTINCT CAST(ts AS DATE)) AS n_days,
           count(DISTINCT date_trunc('month', ts)) AS n_months, count(DISTINCT year(ts)) AS n_years, count(*) AS n_rows
    FROM events GROUP BY 1
    """,
)
def distinct_profile(spark, sf_dir):
    return summary.distinct_profile(events(spark, sf_dir), "user_id", "ts")


@query(
    "profile",
    """
    SELECT 'value' AS "column", count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
           min(value) AS min, max(value) AS max FROM events
    UNION ALL
    SELECT 'user_id', count(user_id), round(avg(user_id), 4), round(stddev_samp(user_id), 4),
           CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events
    """,
)
def profile(spark, sf_dir):
    return summary.profile(events(spark, sf_dir), ["value", "user_id"])


@query(
    "top_wind",
    "SELECT event_id, event_type, ts, value FROM events ORDER BY value DESC, event_id LIMIT 100",
)
def top_wind(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type", "ts", "value")
    return rows.orderBy(F.desc("value"), "event_id").limit(100)


@query(
    "publish_minute",
    """
    WITH c AS (SELECT ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT CAST(minute(ts) AS INTEGER) AS minute, count(*) AS n_readings
    FROM c WHERE p IS NOT NULL AND p <> event_type GROUP BY 1
    """,
)
def publish_minute(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    return summary.publish_minute(dedup.change_only(rows, "user_id", "event_type", ["ts", "event_id"]), "ts")


@query(
    "publish_minute_quantiles",
    """
    WITH c AS (SELECT ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT quantile_cont(minute(ts), 0.5) AS median_minute, quantile_cont(minute(ts), 0.9) AS p90_minute
    FROM c WHERE p IS NOT NULL AND p <> event_type
    """,
)
def publish_minute_quantiles(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    changes = dedup.change_only(rows, "user_id", "event_type", ["ts", "event_id"])
    shares = summary.publish_minute_quantiles(changes, "ts", [0.5, 0.9])
    return shares.select(F.col("minutes")[0].alias("median_minute"), F.col("minutes")[1].alias("p90_minute"))


@query(
    "dup_summary",
    """
    WITH m AS (SELECT lang, doc_id, n_chars, md5(text) AS h FROM documents),
         l AS (SELECT lang, h, lag(h) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS p FROM m)
    SELECT lang, count(*) AS n_files, CAST(sum(CASE WHEN h = p THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicates
    FROM l GROUP BY lang
    """,
)
def dup_summary(spark, sf_dir):
    docs = dedup.fingerprint_table(table(spark, sf_dir, "documents"), "text", "lang", "n_chars", "doc_id")
    flagged = dedup.consecutive_flags(docs, "lang", "content_md5", ["n_chars", "doc_id"])
    return dedup.duplicate_summary(flagged, "lang", F.col("is_dup"))


@query(
    "numeric_coerce",
    """
    SELECT event_id, TRY_CAST(regexp_extract(props, ': *([^}]*)', 1) AS DOUBLE) AS k,
           TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events
    """,
)
def numeric_coerce(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        number(F.regexp_extract("props", ": *([^}]*)", 1)).alias("k"),
        number("event_type").alias("not_a_number"),
    )


@query(
    "trend_quadratic",
    """
    WITH x AS (SELECT event_type AS station, CAST(ts AS DATE) AS obs_date, value AS y,
                      date_diff('microsecond', date_trunc('day', ts), ts) / 86400000000.0 - 0.5 AS x FROM events WHERE value IS NOT NULL),
         s AS (SELECT station, obs_date, count(*) AS n_obs, CAST(count(*) AS DOUBLE) AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3,
                      sum(x * x * x * x) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2, count(DISTINCT x) AS d FROM x GROUP BY 1, 2),
         c AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det,
                      s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2) AS d1,
                      s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) AS d2 FROM s)
    SELECT station, obs_date, n_obs, CASE WHEN d > 2 THEN round((d1 - d2) / det, 4) END AS slope FROM c
    """,
)
def trend_quadratic(spark, sf_dir):
    """The linear coefficient, at midnight, of a parabola through each day's readings; sums are stored per day and merged before use."""
    rows = events(spark, sf_dir).withColumn("part", F.col("event_id") % 3)
    x = F.timestamp_diff("MICROSECOND", F.to_date("ts").cast("timestamp_ntz"), F.col("ts")) / F.lit(86_400_000_000.0) - F.lit(0.5)
    keyed = rows.select(F.col("event_type").alias("station"), F.to_date("ts").alias("obs_date"), "part", x.alias("x"), "value")
    parts = trend.moments(keyed, ["station", "obs_date", "part"], F.col("x"), F.col("value"), 2)
    whole = trend.merged_moments(parts, ["station", "obs_date"], 2)
    found = whole.withColumn("_c", trend.coefficients(F.col("xs"), F.col("xys"), 2))
    return found.select("station", "obs_date", F.col("n").alias("n_obs"), F.round(trend.slope_at(F.col("_c"), 2, -0.5), 4).alias("slope"))


@query(
    "range_profile",
    """
    WITH e AS (SELECT event_type AS station, value, strftime(ts, '%Y-%m') AS period FROM events
               WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-24'
               UNION ALL SELECT event_type, value, 'range' FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-24')
    SELECT station, period, count(*) AS n_rows, count(value) AS n_values, round(avg(value), 4) AS mean_value, min(value) AS min_value,
           max(value) AS max_value, quantile_disc(value, 0.25) AS quarter, quantile_disc(value, 0.5) AS middle, count(DISTINCT value) AS n_distinct
    FROM e GROUP BY 1, 2
    """,
)
def range_profile(spark, sf_dir):
    """Quantiles and distinct values of months and of a range from stored sketches of each day. Up to 2,048 values per key they are exact
    (distinct ones up to some hundreds, and nearly so beyond); on larger tables they differ from the SQL within the stated errors."""
    folder = fresh_folder(spark, "sketches")
    sketches.daily_sketches(events(spark, sf_dir), "event_type", "ts", "value").write.partitionBy("obs_date").parquet(folder)
    days = spark.read.parquet(folder)
    found = sketches.range_profile(days, date(2024, 1, 4), date(2024, 1, 24), {"quarter": 0.25, "middle": 0.5})
    return found.withColumn("mean_value", F.round("mean_value", 4))
