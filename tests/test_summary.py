from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gustline.operators import quality, summary

DAY = datetime(2021, 3, 1)
SCHEMA = "station string, ts timestamp_ntz, wind double"


def day_of(spark, *readings):
    return spark.createDataFrame([(s, DAY + timedelta(hours=h), v) for s, h, v in readings], SCHEMA)


def test_daily_summary(spark):
    df = day_of(spark, ("K", 0, 1.0), ("K", 6, 2.0), ("K", 12, 3.0), ("K", 13, None), ("L", 5, 4.0), ("M", 3, 1.0), ("M", 3, 2.0))
    rows = {r.station: r for r in summary.daily_summary(df, "station", "ts", "wind").collect()}
    # one unit in six hours is four a day
    assert tuple(rows["K"]) == ("K", date(2021, 3, 1), 3.0, 1.0, 3, 4.0)
    assert rows["L"].slope == 0.0 and rows["M"].slope is None


def test_slope_equals_least_squares(spark):
    rows = [("K", i * 0.37 % 24, float((i * i * 7) % 23)) for i in range(200)]
    df = day_of(spark, *rows)
    x = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / F.lit(86400.0)
    want = df.groupBy(F.to_date("ts")).agg(F.regr_slope("wind", x).alias("s")).first().s
    assert summary.daily_summary(df, "station", "ts", "wind").first().slope == pytest.approx(want, rel=1e-3)


def test_profiles(spark):
    df = day_of(spark, ("K", 0, 1.0), ("K", 24, 2.0), ("K", 24 * 31, 3.0), ("K", 24 * 400, None))
    row = summary.profile(df, ["wind"], quartiles=True).first()
    assert (row.n, row.mean, row.std, row["min"], row["max"], row.quartiles) == (3, 2.0, 1.0, 1.0, 3.0, [1.0, 2.0, 3.0])
    assert tuple(summary.distinct_profile(df, "station", "ts").first()) == ("K", 4, 3, 2, 4)


def test_publish_minute(spark):
    df = day_of(spark, *[("K", m / 60, 1.0) for m in (20, 20, 41, 80)])
    counts = {r.minute: r.n_readings for r in summary.publish_minute(df, "ts").collect()}
    assert counts == {20: 3, 41: 1}
    assert summary.publish_minute_quantiles(df, "ts", [0.5, 1.0]).first().minutes == [20.0, 41.0]


def test_sanity_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, "N", 5.0), (2, None, 5.0)], "id int, wind_dir string, wind_mph double")
    flagged, suspect = quality.sanity_split(df, ("wind_dir", "wind_mph"))
    assert flagged.count() == 2 and [r.id for r in suspect.collect()] == [2]
