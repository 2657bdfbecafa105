"""Gap audit, repair and ordered duplicate rules."""

from pyspark.sql import functions as F

from gustline.functions.times import emit_time, hour_floor
from gustline.operators import audit, dedup
from gustline.plans.registry import events, query, table

# Arrival order of a reading: a fixed shuffle of the id, with the id as tie-break.
ARRIVAL = "pmod(event_id * 7919, 1000003)"
ARRIVAL_SQL = "(event_id * 7919) % 1000003"


def _arrivals(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").alias("station"), "ts")
    return rows.withColumn("arrival", F.expr(ARRIVAL))


_HOURS = "SELECT DISTINCT event_type AS station, date_trunc('hour', ts) AS obs_hour FROM events"


@query(
    "gap_list",
    f"""
    WITH h AS ({_HOURS}),
         l AS (SELECT station, obs_hour, coalesce(lag(obs_hour) OVER (PARTITION BY station ORDER BY obs_hour),
                      date_trunc('day', obs_hour) - INTERVAL 1 HOUR) AS prev_ts FROM h)
    SELECT station, m.x AS missing_ts, prev_ts, obs_hour AS next_ts, CAST(m.x AS DATE) AS missing_date
    FROM l, LATERAL (SELECT unnest(generate_series(prev_ts + INTERVAL 1 HOUR, obs_hour - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS x) m
    WHERE obs_hour - prev_ts > INTERVAL 1 HOUR
    """,
)
def gap_list(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("station"), "ts", "event_id")
    hourly = audit.hourly_series(rows, "station", "ts", "event_id")
    return audit.missing_hours(audit.gap_rows(hourly, "station", "obs_hour", ["obs_hour"], None), "station", "obs_hour")


@query(
    "gap_rows",
    """
    WITH h AS (SELECT event_id, user_id AS station, date_trunc('hour', ts) AS obs_hour FROM events),
         l AS (SELECT *, coalesce(lag(obs_hour) OVER (PARTITION BY station ORDER BY event_id),
                      date_trunc('day', obs_hour) - INTERVAL 1 HOUR) AS prev_ts FROM h),
         d AS (SELECT *, date_diff('hour', prev_ts, obs_hour) AS d FROM l)
    SELECT event_id, station, obs_hour, prev_ts, CAST(d AS DOUBLE) AS diff_hours,
           CAST(greatest(d - 1, 0) AS INTEGER) AS n_missing FROM d WHERE d NOT IN (0, 1)
    """,
)
def gap_rows(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("station"), hour_floor("ts").alias("obs_hour")
    )
    return audit.gap_rows(rows, "station", "obs_hour", ["event_id"])


@query(
    "gap_rows_offset",
    """
    WITH r AS (SELECT event_id, event_type AS station, date_trunc('minute', ts) AS obs FROM events),
         l AS (SELECT *, lag(obs) OVER (PARTITION BY station ORDER BY obs, event_id) AS p FROM r),
         d AS (SELECT event_id, station, obs, coalesce(p, date_trunc('day', obs) + minute(obs) * INTERVAL 1 MINUTE - INTERVAL 1 HOUR) AS prev_ts FROM l),
         h AS (SELECT *, date_diff('minute', prev_ts, obs) AS m FROM d)
    SELECT event_id, station, obs, prev_ts, round(m / 60.0, 6) AS diff_hours, CAST(greatest(m // 60 - 1, 0) AS INTEGER) AS n_missing
    FROM h WHERE m NOT IN (0, 60)
    """,
)
def gap_rows_offset(spark, sf_dir):
    """Gaps of readings at any minute of the hour."""
    obs = F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("obs")
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("station"), obs)
    found = audit.gap_rows(rows, "station", "obs", ["obs", "event_id"])
    return found.withColumn("diff_hours", F.round("diff_hours", 6))


AS_OF = "2024-01-20 10:30:00"


@query(
    "gap_fill_as_of",
    f"""
    WITH e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{AS_OF}'),
         h AS (SELECT event_type AS station, date_trunc('hour', ts) AS obs_hour, arg_max(value, (ts, event_id)) AS value FROM e GROUP BY 1, 2),
         c AS (SELECT station, min(CAST(obs_hour AS DATE)) AS d0, max(CAST(obs_hour AS DATE)) AS d1 FROM h GROUP BY 1),
         cal AS (SELECT station, x.t AS obs_hour FROM c, LATERAL (SELECT unnest(generate_series(
                      CAST(d0 AS TIMESTAMP), least(CAST(d1 AS TIMESTAMP) + INTERVAL 23 HOUR, TIMESTAMP '{AS_OF}'), INTERVAL 1 HOUR)) AS t) x)
    SELECT cal.station, cal.obs_hour, h.value, h.obs_hour IS NULL AS is_added
    FROM cal LEFT JOIN h ON h.station = cal.station AND h.obs_hour = cal.obs_hour
    """,
)
def gap_fill_as_of(spark, sf_dir):
    """The audit of a running day: no row is added after the given time."""
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    rows = events(spark, sf_dir).where(F.col("ts") <= as_of)
    rows = rows.select(F.col("event_type").alias("station"), "ts", "event_id", "value")
    hourly = audit.hourly_series(rows, "station", "ts", "event_id", "value")
    return audit.gap_fill(hourly, "station", ["value"], as_of=as_of)


@query(
    "backwards_rows",
    f"""
    WITH a AS (SELECT event_id, user_id AS station, ts, {ARRIVAL_SQL} AS arrival FROM events),
         l AS (SELECT *, lag(ts) OVER (PARTITION BY station ORDER BY arrival, event_id) AS prev_ts FROM a)
    SELECT event_id, station, ts, arrival, prev_ts FROM l WHERE ts < prev_ts
    """,
)
def backwards_rows(spark, sf_dir):
    return audit.backwards_rows(_arrivals(spark, sf_dir), "station", "ts", ["arrival", "event_id"])


@query(
    "gap_fill",
    """
    WITH h AS (SELECT event_type AS station, date_trunc('hour', ts) AS obs_hour,
                      arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1, 2),
         c AS (SELECT station, arg_min(props, obs_hour) AS props, min(CAST(obs_hour AS DATE)) AS d0,
                      max(CAST(obs_hour AS DATE)) AS d1 FROM h GROUP BY 1),
         cal AS (SELECT station, props, x.t AS obs_hour FROM c, LATERAL (SELECT unnest(generate_series(
                      CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS t) x)
    SELECT station, obs_hour, value, props, false AS is_added FROM h
    UNION ALL
    SELECT cal.station, cal.obs_hour, NULL, cal.props, true FROM cal
    WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.station = cal.station AND h.obs_hour = cal.obs_hour)
    """,
)
def gap_fill(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("station"), "ts", "event_id", "value", "props")
    hourly = audit.hourly_series(rows, "station", "ts", "event_id", "value", "props")
    return audit.gap_fill(hourly, "station", ["value"], ["props"])


_RETIME_CTES = """
    r AS (SELECT event_id, event_type || '-' || CAST(user_id % 3 AS VARCHAR) AS station,
                      date_trunc('hour', ts) AS obs_hour, value FROM events),
         l AS (SELECT *, lag(obs_hour) OVER w AS p, lag(event_id) OVER w AS pid FROM r
               WINDOW w AS (PARTITION BY station ORDER BY obs_hour, event_id)),
         g AS (SELECT *, CAST(obs_hour AS DATE) AS d, coalesce(date_diff('hour', p, obs_hour) - 1, -1) AS nm FROM l),
         days AS (SELECT station, d FROM g GROUP BY 1, 2 HAVING count(*) = 24),
         fix AS (SELECT g.pid, g.p + g.nm * INTERVAL 1 HOUR AS t,
                        row_number() OVER (PARTITION BY g.station, g.d ORDER BY g.obs_hour DESC, g.event_id DESC) AS rn
                 FROM g JOIN days USING (station, d) WHERE g.nm >= 1),
         t AS (SELECT r.event_id, r.station, coalesce(f.t, r.obs_hour) AS obs_hour,
                      CASE WHEN f.pid IS NULL THEN r.value END AS value, f.pid IS NOT NULL AS is_retimed
               FROM r LEFT JOIN (SELECT * FROM fix WHERE rn = 1) f ON r.event_id = f.pid)
    """


def _hour_rows(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("station"),
        hour_floor("ts").alias("obs_hour"),
        "value",
    )


@query("retime_repair", f"WITH {_RETIME_CTES} SELECT event_id, station, obs_hour, value, is_retimed FROM t")
def retime_repair(spark, sf_dir):
    return audit.retime_repair(_hour_rows(spark, sf_dir), "station", "obs_hour", "event_id", ["value"])


@query(
    "audit_repair",
    f"""
    WITH {_RETIME_CTES},
         h AS (SELECT station, obs_hour, arg_max(coalesce(value, -1), event_id) AS value FROM t GROUP BY 1, 2),
         c AS (SELECT station, min(CAST(obs_hour AS DATE)) AS d0, max(CAST(obs_hour AS DATE)) AS d1 FROM h GROUP BY 1),
         cal AS (SELECT station, x.t AS obs_hour FROM c, LATERAL (SELECT unnest(generate_series(
                      CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS t) x)
    SELECT cal.station, cal.obs_hour, nullif(h.value, -1) AS value, h.obs_hour IS NULL AS is_added
    FROM cal LEFT JOIN h ON h.station = cal.station AND h.obs_hour = cal.obs_hour
    """,
)
def audit_repair(spark, sf_dir):
    return audit.audit(_hour_rows(spark, sf_dir), "station", "obs_hour", "event_id", ["value"], [])


HIGHWATER_SQL = f"""
    WITH a AS (SELECT event_id, user_id AS station, ts, {ARRIVAL_SQL} AS arrival FROM events),
         m AS (SELECT *, max(ts) OVER (PARTITION BY station ORDER BY arrival, event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM a)
    SELECT event_id, station, ts, arrival FROM m WHERE high IS NULL OR ts > high
    """


@query("highwater_accept", HIGHWATER_SQL)
def highwater_accept(spark, sf_dir):
    return dedup.highwater_accept(_arrivals(spark, sf_dir), "station", "ts", ["arrival", "event_id"])


@query(
    "change_only",
    """
    WITH c AS (SELECT event_id, user_id, event_type, strftime(ts, '%m/%d/%y %H:%M:%S') AS collection_time,
                      lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT event_id, user_id, event_type, collection_time FROM c WHERE p IS NOT NULL AND p <> event_type
    """,
)
def change_only(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    changes = dedup.change_only(rows, "user_id", "event_type", ["ts", "event_id"])
    return changes.select("event_id", "user_id", "event_type", emit_time("ts", "excel").alias("collection_time"))


@query(
    "consecutive_dup",
    """
    WITH m AS (SELECT lang, doc_id, n_chars, md5(text) AS content_md5 FROM documents),
         l AS (SELECT *, lag(content_md5) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS p FROM m)
    SELECT lang, n_chars, doc_id, content_md5 FROM l WHERE content_md5 = p
    """,
)
def consecutive_dup(spark, sf_dir):
    docs = dedup.fingerprint_table(table(spark, sf_dir, "documents"), "text", "lang", "n_chars", "doc_id")
    return dedup.consecutive_duplicates(docs, "lang", "content_md5", ["n_chars", "doc_id"])


@query(
    "any_dup",
    """
    WITH m AS (SELECT doc_id, md5(text) AS content_md5 FROM documents),
         f AS (SELECT *, min(doc_id) OVER (PARTITION BY content_md5) AS first_id FROM m)
    SELECT content_md5, doc_id, first_id FROM f WHERE doc_id > first_id
    """,
)
def any_dup(spark, sf_dir):
    docs = dedup.fingerprint_table(table(spark, sf_dir, "documents"), "text", "doc_id")
    return dedup.any_duplicates(docs, "content_md5", "doc_id")


@query(
    "plateau_flag",
    """
    WITH k AS (SELECT event_id, event_type AS station, ts, CAST(regexp_extract(props, ': *([^}]*)', 1) AS DOUBLE) AS k FROM events)
    SELECT event_id, station, ts, k,
           coalesce(lead(k) OVER (PARTITION BY station ORDER BY ts, event_id) = k, false) AS is_plateau FROM k
    """,
)
def plateau_flag(spark, sf_dir):
    k = F.regexp_extract("props", ": *([^}]*)", 1).try_cast("double")
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("station"), "ts", k.alias("k"))
    return audit.plateau_flag(rows, "station", "k", ["ts", "event_id"])


@query(
    "rollover_segments",
    """
    WITH l AS (SELECT event_id, user_id AS station, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
         c AS (SELECT event_id, station, ts, CASE WHEN p IS NULL OR CAST(ts AS DATE) > CAST(p AS DATE)
                      OR (hour(ts) <> hour(p) AND (hour(ts) - hour(p)) % 6 = 0) THEN 1 ELSE 0 END AS cut FROM l)
    SELECT event_id, station, ts,
           CAST(sum(cut) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM c
    """,
)
def rollover_segments(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").alias("station"), "ts")
    return audit.rollover_segments(rows, "station", "ts", ["ts", "event_id"], every_hours=6)


@query(
    "tumbling_segments",
    """
    SELECT event_id, ts, date_trunc('day', ts) + (hour(ts) // 6) * INTERVAL 6 HOUR AS segment_start FROM events
    """,
)
def tumbling_segments(spark, sf_dir):
    return audit.tumbling_segments(events(spark, sf_dir).select("event_id", "ts"), "ts", 6)
