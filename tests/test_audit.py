from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from gustline.operators import audit

DAY = datetime(2021, 3, 1)
SCHEMA = "station string, id int, ts timestamp_ntz, wind double, loc string"


def series(spark, *hours, station="KDCA"):
    rows = [(station, i, DAY + timedelta(hours=h), float(i), "DC") for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, SCHEMA)


def gaps(df):
    flagged = audit.gap_rows(df, "station", "ts", ["id"])
    return sorted(r.missing_ts for r in audit.missing_hours(flagged, "station", "ts").collect())


def test_full_day_has_no_gap(spark):
    assert gaps(series(spark, *range(24))) == []


def test_full_day_at_any_minute_has_no_gap(spark):
    df = series(spark, *[h + 52 / 60 for h in range(24)])
    assert audit.gap_rows(df, "station", "ts", ["id"]).count() == 0


def test_a_wrong_century_is_no_large_array(spark):
    rows = [("K", 0, datetime(1921, 3, 1), 1.0, "x"), ("K", 1, datetime(2021, 3, 1), 1.0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    flagged = audit.gap_rows(df, "station", "ts", ["id"])
    missing = audit.missing_hours(flagged, "station", "ts")
    n = (datetime(2021, 3, 1) - datetime(1921, 3, 1)).days * 24 - 1
    assert missing.count() == n and missing.select("missing_ts").distinct().count() == n
    filled = audit.gap_fill(audit.hourly_series(df, "station", "ts", "id", "wind"), "station", ["wind"])
    assert filled.count() == n + 1 + 24


def test_nothing_is_added_after_as_of(spark):
    now = DAY + timedelta(hours=8, minutes=30)
    as_of = F.lit(now).cast("timestamp_ntz")
    df = series(spark, 0, 1, 2, 5, 6, 7, 8)
    hourly = audit.hourly_series(df, "station", "ts", "id", "wind")
    filled = audit.gap_fill(hourly, "station", ["wind"], as_of=as_of).collect()
    assert sorted(r.obs_hour for r in filled) == [DAY + timedelta(hours=h) for h in range(9)]
    assert audit.day_completeness(series(spark, *range(9)), "station", "ts", as_of).first().is_short is False
    assert audit.day_completeness(df, "station", "ts", as_of).first().is_short is True


def test_gap_and_day_start(spark):
    assert gaps(series(spark, 2, 3, 6)) == [DAY + timedelta(hours=h) for h in (0, 1, 4, 5)]


def test_hours_belong_to_their_own_date(spark):
    flagged = audit.gap_rows(series(spark, 0, 22, 26), "station", "ts", ["id"])
    rows = audit.missing_hours(flagged, "station", "ts").collect()
    assert {r.missing_ts.date() for r in rows if r.prev_ts.hour == 22} == {date(2021, 3, 1), date(2021, 3, 2)}
    assert all(r.missing_ts.date() == r.missing_date for r in rows)


def test_backwards_and_half_hours(spark):
    df = series(spark, 0, 1, 1.5, 0.5, 3)
    flagged = {r.id: (r.diff_hours, r.n_missing) for r in audit.gap_rows(df, "station", "ts", ["id"]).collect()}
    assert flagged == {2: (0.5, 0), 3: (-1.0, 0), 4: (2.5, 1)}
    assert [r.id for r in audit.backwards_rows(df, "station", "ts", ["id"]).collect()] == [3]


def test_gap_over_month_and_year_edges(spark):
    start = datetime(2021, 12, 31, 22)
    df = spark.createDataFrame([("K", 0, start, 1.0, "x"), ("K", 1, start + timedelta(hours=4), 1.0, "x")], SCHEMA)
    assert gaps(df)[-3:] == [datetime(2021, 12, 31, 23), datetime(2022, 1, 1, 0), datetime(2022, 1, 1, 1)]


def test_retime_moves_the_row_before_the_last_gap(spark):
    # 24 rows: hour 10 is written twice instead of hour 11
    df = series(spark, *range(11), 10, *range(12, 24))
    fixed = audit.retime_repair(df, "station", "ts", "id", ["wind"]).collect()
    moved = [r for r in fixed if r.is_retimed]
    assert [(r.id, r.ts, r.wind, r["loc"]) for r in moved] == [(11, DAY + timedelta(hours=11), None, "DC")]
    assert sorted(r.ts for r in fixed) == [DAY + timedelta(hours=h) for h in range(24)]


def test_retime_leaves_other_days_alone(spark):
    short = series(spark, *range(10), *range(12, 24))
    full = series(spark, *range(24), station="KIAD").withColumn("id", F.col("id") + 100)
    rows = audit.retime_repair(short.union(full), "station", "ts", "id", ["wind"])
    assert rows.where("is_retimed").count() == 0


def test_retime_skips_fractional_steps(spark):
    df = series(spark, *range(12), 12.5, *range(13, 24))
    assert audit.retime_repair(df, "station", "ts", "id", ["wind"]).where("is_retimed").count() == 0


def test_gap_fill(spark):
    df = series(spark, *range(5), *range(8, 20), 49)
    hourly = audit.hourly_series(df, "station", "ts", "id", "wind", "loc")
    filled = audit.gap_fill(hourly, "station", ["wind"], ["loc"]).collect()
    assert len(filled) == audit.gap_fill(hourly.drop("loc"), "station", ["wind"]).count() == 72
    assert sorted(r.obs_hour for r in filled) == [DAY + timedelta(hours=h) for h in range(72)]
    added = [r for r in filled if r.is_added]
    assert len(added) == 72 - 18 and all(r.wind is None and r["loc"] == "DC" for r in added)


def test_hourly_series_keeps_the_newest(spark):
    df = series(spark, 1, 1.25, 1.5, 2)
    rows = audit.hourly_series(df, "station", "ts", "id", "wind").orderBy("obs_hour").collect()
    assert [(r.obs_hour.hour, r.wind) for r in rows] == [(1, 2.0), (2, 3.0)]


def test_day_completeness(spark):
    df = series(spark, *range(24), 24, 24.5)
    rows = audit.day_completeness(df, "station", "ts").orderBy("obs_date").collect()
    assert [tuple(r)[2:] for r in rows] == [(24, 24, False), (2, 1, True)]


def test_whole_audit(spark):
    df = series(spark, *range(11), 10, *range(12, 24), *range(24, 40))
    done = audit.audit(df, "station", "ts", "id", ["wind"], ["loc"]).collect()
    assert sorted(r.obs_hour for r in done) == [DAY + timedelta(hours=h) for h in range(48)]
    assert sum(r.is_added for r in done) == 8


def test_rollover(spark):
    df = series(spark, 0, 5, 6, 12, 23, 24, 25, 24 * 31)
    day = audit.rollover_segments(df, "station", "ts", ["id"]).orderBy("id").collect()
    assert [r.segment for r in day] == [1, 1, 1, 1, 1, 2, 2, 3]
    six = audit.rollover_segments(df, "station", "ts", ["id"], every_hours=6).orderBy("id").collect()
    assert [r.segment for r in six] == [1, 1, 1, 2, 2, 3, 3, 4]
    starts = audit.tumbling_segments(df, "ts", 6).orderBy("id").collect()
    assert [r.segment_start.hour for r in starts] == [0, 0, 6, 12, 18, 0, 0, 0]


def test_plateau(spark):
    df = series(spark, 0, 1, 2, 3).withColumn("wind", F.expr("array(1.0d, 1.0d, 2.0d, 2.0d)[id]"))
    rows = audit.plateau_flag(df, "station", "wind", ["ts"]).orderBy("id").collect()
    assert [r.is_plateau for r in rows] == [True, False, True, False]
