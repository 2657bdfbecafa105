"""Lookups, enrichment, fallback and as-of queries."""

from datetime import date

from pyspark.sql import functions as F

from gustline.functions.times import file_key, hour_floor
from gustline.operators import dedup, latest, lookups, zones
from gustline.operators.latest import best_source
from gustline.plans.registry import events, query, table

AS_OF = date(1998, 6, 30)


@query(
    "dim_lookup",
    """
    SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
    """,
)
def dim_lookup(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")


@query(
    "zone_lookup",
    """
    WITH p AS (SELECT upper(n_name) AS abbr, n_nationkey, n_regionkey * 60 AS off FROM nation),
         x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EST' WHEN 1 THEN 'CHST' WHEN 2 THEN 'pm'
                      ELSE substr(upper(n_name), 1, 5) END AS k
               FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, k AS zone, CASE k WHEN 'EST' THEN -300 WHEN 'CHST' THEN 600 WHEN 'pm' THEN NULL
           ELSE (SELECT arg_min(off, n_nationkey) FROM p WHERE starts_with(p.abbr, k)) END AS offset_minutes FROM x
    """,
)
def zone_lookup(spark, sf_dir):
    # nations stand for the zone table, in key order; a customer's zone is a prefix of its nation's name
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    zones = nation.select(
        F.upper("n_name").alias("abbr"), (F.col("n_regionkey") * 60).alias("offset_minutes"), F.col("n_nationkey").alias("line_no")
    )
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    kind = F.col("c_custkey") % 4
    zone = F.when(kind == 0, "EST").when(kind == 1, "CHST").when(kind == 2, "pm").otherwise(F.substring(F.upper("n_name"), 1, 5))
    return lookups.zone_lookup(named.select("c_custkey", zone.alias("zone")), "zone", zones)


# Daylight time of the years 1990 to 2006: North America from 2 h on the first Sunday of April to 2 h on the last one of October, Sydney
# from 2 h on the last Sunday of October (of August in 2000) to 3 h on the first one of March, from 1996 on the last one.
_ZONE_SQL = """
    WITH l AS (SELECT l_orderkey, l_linenumber, ['ET', 'CT', 'AET', 'EST', 'XX'][CAST(l_orderkey % 5 + 1 AS INTEGER)] AS zone,
                      l_shipdate + to_minutes(CAST((l_orderkey * 7 + l_linenumber * 211) % 1440 AS INTEGER)) AS wall FROM lineitem),
         d AS (SELECT *, make_date(year(wall), 4, 1) AS a1, make_date(year(wall), 10, 31) AS o31, make_date(year(wall), 3, 1) AS m1,
                      make_date(year(wall), 3, 31) AS m31 FROM l),
         e AS (SELECT *, (a1 + CAST((7 - dayofweek(a1)) % 7 AS INTEGER))::TIMESTAMP + INTERVAL 2 HOUR AS us_on,
                      (o31 - CAST(dayofweek(o31) AS INTEGER))::TIMESTAMP + INTERVAL 2 HOUR AS last_october,
                      (CASE WHEN year(wall) >= 1996 THEN m31 - CAST(dayofweek(m31) AS INTEGER)
                            ELSE m1 + CAST((7 - dayofweek(m1)) % 7 AS INTEGER) END)::TIMESTAMP + INTERVAL 3 HOUR AS au_off FROM d),
         k AS (SELECT *, CASE WHEN zone <> 'AET' THEN us_on WHEN year(wall) = 2000 THEN TIMESTAMP '2000-08-27 02:00:00' ELSE last_october END AS starts, CASE zone WHEN 'AET' THEN au_off ELSE last_october END AS ends FROM e),
         z AS (SELECT *, CASE WHEN zone IN ('EST', 'XX') THEN NULL WHEN wall >= starts AND wall < starts + INTERVAL 1 HOUR THEN 'gap'
                              WHEN wall >= ends - INTERVAL 1 HOUR AND wall < ends THEN 'overlap' ELSE 'plain' END AS zone_kind,
                      CASE zone WHEN 'EST' THEN -300 WHEN 'AET' THEN CASE WHEN wall < ends OR wall >= starts THEN 660 ELSE 600 END
                                WHEN 'ET' THEN CASE WHEN wall >= starts AND wall < ends THEN -240 ELSE -300 END
                                WHEN 'CT' THEN CASE WHEN wall >= starts AND wall < ends THEN -300 ELSE -360 END END AS offset_minutes FROM k)
    SELECT l_orderkey, l_linenumber, zone, wall, zone_kind, offset_minutes, wall - to_minutes(offset_minutes) AS utc_time,
           CASE zone_kind WHEN 'gap' THEN wall - INTERVAL 1 HOUR WHEN 'overlap' THEN wall WHEN 'plain' THEN wall END AS local_again FROM z
"""


@query("zone_instants", _ZONE_SQL)
def zone_instants(spark, sf_dir):
    """Wall clocks with two-valued, fixed and unknown zones -> instants by each zone's rules, and back to the wall clock of that instant."""
    rows = table(spark, sf_dir, "lineitem")
    minute = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 211) % 1440
    names = F.array(*[F.lit(x) for x in ("ET", "CT", "AET", "EST", "XX")])
    rows = rows.select(
        "l_orderkey", "l_linenumber", F.element_at(names, (F.col("l_orderkey") % 5 + 1).cast("int")).alias("zone"),
        (F.col("l_shipdate") + F.make_dt_interval(mins=minute.cast("int"))).alias("wall"),
    )
    regions = zones.regions(spark)
    # a zone table without the two-valued abbreviations
    fixed = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Q"), F.upper("n_name")).alias("abbr"), F.col("n_regionkey").alias("offset_minutes"), F.col("n_nationkey").alias("line_no")
    )
    found = zones.zone_lookup_at(rows, "zone", "wall", fixed, regions, zones.wall_spans(regions, 1991, 2003))
    found = found.withColumn("utc_time", F.col("wall") - F.make_dt_interval(mins=F.col("offset_minutes")))
    found = found.join(regions.select(F.col("abbr").alias("zone"), F.col("zone").alias("region")), "zone", "left")
    found = zones.wall_clock_at(found, "region", "utc_time", zones.instant_spans(regions, 1991, 2003), "local_again")
    return found.select("l_orderkey", "l_linenumber", "zone", "wall", "zone_kind", "offset_minutes", "utc_time", "local_again")


@query(
    "enrich_left",
    """
    WITH o AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
                      arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1)
    SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN o ON c_custkey = o_custkey
    """,
)
def enrich_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lookups.enrich_stations(customer, orders, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query(
    "source_fallback",
    """
    WITH b AS (SELECT user_id % 10 AS station, date_trunc('hour', ts) AS obs_hour, event_id, value,
                      CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS priority FROM events),
         r AS (SELECT *, row_number() OVER (PARTITION BY station, obs_hour ORDER BY priority, event_id) AS rn FROM b)
    SELECT station, obs_hour, event_id, value, priority FROM r WHERE rn = 1
    """,
)
def source_fallback(spark, sf_dir):
    # clicks are the primary source, all other events the alternate; both come from one scan
    rows = events(spark, sf_dir).select(
        (F.col("user_id") % 10).alias("station"), hour_floor("ts").alias("obs_hour"), "event_id", "value",
        F.when(F.col("event_type") == "click", 0).otherwise(1).alias("priority"),
    )
    return best_source(rows, ["station", "obs_hour"], "priority", "event_id", ["event_id", "value", "priority"])


@query(
    "new_content_anti",
    """
    WITH d AS (SELECT user_id AS station, CAST(ts AS DATE) AS obs_date, ts, event_id, event_type, props FROM events),
         s AS (SELECT station, obs_date, arg_max(props, (ts, md5(props))) AS props FROM d WHERE event_type <> 'click' GROUP BY 1, 2)
    SELECT d.station, d.obs_date, d.event_id, d.props FROM d
    LEFT JOIN s a ON a.station = d.station AND a.obs_date = d.obs_date
    LEFT JOIN s b ON b.station = d.station AND b.obs_date = d.obs_date - 1
    WHERE d.event_type = 'click' AND coalesce(a.props, b.props, '') <> d.props
    """,
)
def new_content_anti(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        F.col("user_id").alias("station"), F.to_date("ts").alias("obs_date"), "ts", "event_id", "event_type", "props"
    )
    incoming = rows.where("event_type = 'click'").select("station", "obs_date", "event_id", "props")
    return dedup.skip_unchanged(incoming, rows.where("event_type <> 'click'"), "station", "obs_date", "props", "ts").select(
        "station", "obs_date", "event_id", "props"
    )


@query(
    "asof_latest",
    f"""
    SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
           max(o_orderdate) AS o_orderdate FROM orders
    WHERE o_orderdate < DATE '{AS_OF}' + 2 GROUP BY 1
    """,
)
def asof_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return latest.asof_latest(orders, "o_custkey", "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderdate"], F.lit(AS_OF))


@query(
    "fresh_semi",
    f"""
    SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
           AND CAST(o_orderdate AS DATE) BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}')
    """,
)
def fresh_semi(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return lookups.fresh_keys(customer, orders, "c_custkey", "o_orderdate", F.lit(AS_OF))


@query(
    "latest_per_key",
    """
    WITH r AS (SELECT user_id, CAST(ts AS DATE) AS obs_date, event_id, ts, value,
                      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, obs_date, event_id, ts, value FROM r WHERE rn = 1
    """,
)
def latest_per_key(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("obs_date", F.to_date("ts"))
    return latest.latest_per_key(rows, ["user_id", "obs_date"], ["ts", "event_id"], ["event_id", "ts", "value"])


@query(
    "nth_row",
    """
    WITH r AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, event_id, ts, value FROM r WHERE rn = 5
    """,
)
def nth_row(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    return latest.nth_row(rows, ["user_id"], ["ts", "event_id"], 5, newest_first=True)


@query(
    "nth_row_deep",
    """
    WITH r AS (SELECT event_type, event_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
    SELECT event_type, event_id, ts, value FROM r WHERE rn = 20
    """,
)
def nth_row_deep(spark, sf_dir):
    """The ordered-scan form, which has no limit on n."""
    rows = events(spark, sf_dir).select("event_type", "event_id", "ts", "value")
    return latest.numbered_row(rows, ["event_type"], ["ts", "event_id"], 20)


@query(
    "newest_file",
    """
    SELECT event_type AS station, max(event_type || strftime(ts, '_Y%Y_M%m_D%d_H%H') || '.csv') AS file_name
    FROM events WHERE date_trunc('month', ts) = DATE '2024-01-01' AND CAST(ts AS DATE) <= DATE '2024-01-20' GROUP BY 1
    """,
)
def newest_file(spark, sf_dir):
    files = events(spark, sf_dir).select(file_key("event_type", "ts").alias("file_name"))
    return latest.newest_file(files, "file_name", F.lit(date(2024, 1, 20)))
