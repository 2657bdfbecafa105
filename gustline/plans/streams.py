"""Streaming jobs over the events table, run until all available input is processed."""

from datetime import timedelta

from pyspark.sql import functions as F

from gustline.functions.times import hour_floor, wall_clock
from gustline.operators.quality import is_suspect
from gustline.plans.audits import ARRIVAL, ARRIVAL_SQL, HIGHWATER_SQL
from gustline.plans.registry import events, query
from gustline.session import fresh_folder
from gustline.streaming import fallback, ingest

SHARES = 2


class Feed:
    """Events as a feed that arrives in shares. The table is read once and written with its own partitions, by share; a share arrives by
    being moved into the folder that the stream watches, and the job is stopped between shares and resumed from its checkpoint."""

    def __init__(self, rows, purpose, place, shares=SHARES):
        self.spark, self.folder, self.shares = rows.sparkSession, fresh_folder(rows.sparkSession, purpose), shares
        rows.withColumn("_share", F.least(place, F.lit(shares - 1))).write.partitionBy("_share").parquet(f"{self.folder}/ahead")
        self.schema = rows.schema

    def stream(self):
        return ingest.table_stream(self.spark, f"{self.folder}/in", schema=self.schema, recursive=True)

    def arrive(self, share):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.mkdirs(path(f"{self.folder}/in"))
        ahead = path(f"{self.folder}/ahead/_share={share}")
        if store.exists(ahead):
            store.rename(ahead, path(f"{self.folder}/in/share-{share}"))

    def run(self, start):
        """``start(stream)`` for each share in turn, to its end."""
        for share in range(self.shares):
            self.arrive(share)
            start(self.stream()).awaitTermination()
        return self.folder


def _feed(spark, sf_dir, purpose):
    """Events in an order of arrival that is not that of their times."""
    rows = events(spark, sf_dir).withColumn("arrival", F.expr(ARRIVAL))
    return Feed(rows, purpose, F.expr(f"cast(arrival * {SHARES} div 1000003 as int)"))


_INGEST_CTES = f"""
    WITH a AS (SELECT event_id, event_type AS station, date_trunc('minute', ts) AS ts, value, {ARRIVAL_SQL} AS arrival FROM events
               WHERE CAST(ts AS DATE) = CAST(ts + (event_id % 6) * INTERVAL 1 HOUR AS DATE) OR hour(ts) = 23),
         h AS (SELECT *, max(ts) OVER (PARTITION BY station ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM a),
         l AS (SELECT *, coalesce(ts < high - INTERVAL 48 HOUR, false) AS late FROM h)
    """


def _run_ingest(spark, sf_dir):
    feed = _feed(spark, sf_dir, "stream-ingest")
    folder = feed.folder

    def start(stream):
        rows = stream.select(
            "event_id", F.col("event_type").alias("station"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "value",
            "arrival", F.nullif("event_type", F.lit("error")).alias("wind_dir"), F.col("ts").alias("_ts"),
        )
        local_now = F.col("_ts") + F.make_dt_interval(hours=(F.col("event_id") % 6).cast("int"))
        rows = ingest.drop_late(rows, "_ts", local_now).withColumn("is_suspect", is_suspect(("wind_dir",))).drop("wind_dir", "_ts")
        return ingest.start_clean_ingest(
            rows, f"{folder}/table", f"{folder}/late", f"{folder}/state", f"{folder}/checkpoint", "station", "ts",
            ["arrival", "event_id"], delay_hours=48,
        )

    return feed.run(start)


@query(
    "stream_ingest",
    f"""
    {_INGEST_CTES}, f AS (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY arrival, event_id) AS rn FROM l WHERE NOT late)
    SELECT event_id, station, ts, value, station = 'error' AS is_suspect, CAST(ts AS DATE) AS obs_date FROM f WHERE rn = 1
    """,
)
def stream_ingest(spark, sf_dir):
    rows = spark.read.parquet(f"{_run_ingest(spark, sf_dir)}/table")
    return rows.select("event_id", "station", "ts", "value", "is_suspect", F.to_date("ts").alias("obs_date"))


@query("stream_late_rows", f"{_INGEST_CTES} SELECT event_id, station, ts, value FROM l WHERE late")
def stream_late_rows(spark, sf_dir):
    return spark.read.parquet(f"{_run_ingest(spark, sf_dir)}/late").select("event_id", "station", "ts", "value")


@query(
    "stream_append",
    """
    SELECT event_id, event_type AS station, ts, value, CAST(ts AS DATE) AS obs_date FROM events
    """,
)
def stream_append(spark, sf_dir):
    """The plain append, stopped after its first share and resumed from its checkpoint for the second."""
    feed = _feed(spark, sf_dir, "stream-append")
    folder = feed.folder
    rows = lambda s: s.select("event_id", F.col("event_type").alias("station"), "ts", "value", F.to_date("ts").alias("obs_date"))
    feed.run(lambda stream: ingest.start_ingest(rows(stream), f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/table").select("event_id", "station", "ts", "value", "obs_date")


@query("stream_highwater", HIGHWATER_SQL)
def stream_highwater(spark, sf_dir):
    feed = _feed(spark, sf_dir, "stream-highwater")
    folder = feed.folder
    rows = lambda s: s.select("event_id", F.col("user_id").alias("station"), "ts", "arrival")
    feed.run(lambda stream: ingest.start_highwater(
        rows(stream), f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint", "station", "ts", ["arrival", "event_id"]
    ))
    return spark.read.parquet(f"{folder}/out").select("event_id", "station", "ts", "arrival")


@query(
    "stream_tumbling",
    """
    SELECT event_type AS station, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n_rows,
           max(value) AS max_value, min(value) AS min_value FROM events GROUP BY 1, 2
    """,
)
def stream_tumbling(spark, sf_dir):
    feed = _feed(spark, sf_dir, "stream-tumbling")
    folder = feed.folder
    rows = lambda s: s.select(F.col("event_type").alias("station"), "ts", "value")
    feed.run(lambda stream: ingest.start_tumbling(rows(stream), f"{folder}/out", f"{folder}/checkpoint", "station", "ts", "value"))
    windows = ingest.read_tumbling(spark, f"{folder}/out", "station")
    return windows.select("station", wall_clock(F.col("window_micros")).alias("window_start"), "n_rows", "max_value", "min_value")


@query(
    "stream_content_change",
    f"""
    WITH a AS (SELECT event_id, user_id AS station, props, ts, {ARRIVAL_SQL} AS arrival FROM events),
         l AS (SELECT *, row_number() OVER w AS n, lag(props) OVER w AS p FROM a WINDOW w AS (PARTITION BY station ORDER BY arrival, event_id))
    SELECT event_id, station, props, ts FROM l WHERE n = 1 OR p IS DISTINCT FROM props
    """,
)
def stream_content_change(spark, sf_dir):
    feed = _feed(spark, sf_dir, "stream-content")
    folder = feed.folder
    rows = lambda s: s.select("event_id", F.col("user_id").alias("station"), "props", "ts", "arrival")
    feed.run(lambda stream: ingest.start_content_change(
        rows(stream), f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint", "station", "props", ["arrival", "event_id"]
    ))
    return spark.read.parquet(f"{folder}/out").select("event_id", "station", "props", "ts")


# Minutes by which a row comes after its time; the watermarks wait longer.
_LAG, _DELAY = "event_id * 7919 % 300", "6 hours"
# The station of the last row, whose time lets all others close. It is not NULL: a join would drop such a row before its time counts.
_TICK = "tick"


def _timely(spark, sf_dir, purpose):
    """Events in the order in which they come, some hours late at most, and a last row far behind them so that all hours close."""
    rows = events(spark, sf_dir).select(
        "event_id", F.col("user_id").cast("string").alias("station"), "ts", "value", F.when(F.col("event_type") == "click", 0).otherwise(1).alias("priority")
    )
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    ticks = [(-1 - p, _TICK, last + timedelta(days=3), None, p) for p in (0, 1)]
    rows = rows.unionByName(spark.createDataFrame(ticks, rows.schema))
    rows = rows.withColumn("arrival", F.timestamp_diff("MINUTE", F.lit(first), F.col("ts")) + F.expr(f"pmod({_LAG}, 300)"))
    minutes = int((last - first).total_seconds() // 60) + 1
    return Feed(rows, purpose, F.expr(f"cast(arrival * {SHARES} div {minutes} as int)"), SHARES + 1)


@query(
    "stream_fallback",
    f"""
    WITH b AS (SELECT event_id, CAST(user_id AS VARCHAR) AS station, date_trunc('hour', ts) AS obs_hour, ts, value,
                      CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS priority,
                      CAST(floor(epoch_us(ts) / 60000000.0 - (SELECT epoch_us(min(ts)) FROM events) / 60000000.0) AS BIGINT) + {_LAG} AS arrival FROM events),
         r AS (SELECT *, row_number() OVER (PARTITION BY station, obs_hour ORDER BY priority, arrival, event_id) AS rn FROM b)
    SELECT event_id, station, obs_hour, value, priority FROM r WHERE rn = 1
    """,
)
def stream_fallback(spark, sf_dir):
    """Clicks are the primary source, all other events the alternate: an hour's alternate comes through when its timer finds no primary."""
    feed = _timely(spark, sf_dir, "stream-fallback")
    folder, columns = feed.folder, ["event_id", "station", "ts", "value", "priority"]
    feed.run(lambda stream: fallback.start_fallback(
        stream, f"{folder}/out", f"{folder}/checkpoint", "station", "ts", ["arrival", "event_id"], columns, _DELAY
    ))
    rows = spark.read.parquet(f"{folder}/out").where(F.col("station") != _TICK)
    return rows.select("event_id", "station", hour_floor("ts").alias("obs_hour"), "value", "priority")


@query(
    "stream_pairs",
    """
    WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS station, ts, event_type = 'click' AS is_primary FROM events)
    SELECT p.event_id, p.station, a.event_id AS alt_event_id FROM e p LEFT JOIN e a
        ON p.station = a.station AND NOT a.is_primary AND a.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR WHERE p.is_primary
    """,
)
def stream_pairs(spark, sf_dir):
    """Each click with the other events of its user within an hour, from two streams that each come in their own order."""
    feed = _timely(spark, sf_dir, "stream-pairs")
    folder = feed.folder

    def start(stream):
        primary, alternate = stream.where("priority = 0"), feed.stream().where("priority = 1")
        return fallback.start_pairs(primary, alternate, f"{folder}/out", f"{folder}/checkpoint", "station", "ts", ["event_id", "station"], "1 hour", _DELAY)

    feed.run(start)
    return spark.read.parquet(f"{folder}/out").where(F.col("station") != _TICK).select("event_id", "station", "alt_event_id")
