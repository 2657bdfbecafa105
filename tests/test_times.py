from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gustline.functions import times as T


def test_local_time(values):
    got = values(
        T.parse_local_time,
        "Last Updated on Jan 29 2021, 8:52 am EST",
        " Nov 16 2021, 11:52 pm EST",
        "Nov 16 2021, 12:00 am EST",
        "Nov 16 2021, 12:00 pm EST",
        "Wed, Mar 12 2023, 04:52 am EDT",
        "Nov 23 2022, 1:54 am ChST",
        "NOV 23 2022, 1:54 AM CHST",
        "Mar 12 2023, 2:30:15 am EST",
        "Feb 30 2021, 1:00 am EST",
        "junk",
        None,
    )
    assert got == [
        datetime(2021, 1, 29, 8, 52),
        datetime(2021, 11, 16, 23, 52),
        datetime(2021, 11, 16, 0, 0),
        datetime(2021, 11, 16, 12, 0),
        datetime(2023, 3, 12, 4, 52),
        datetime(2022, 11, 23, 1, 54),
        datetime(2022, 11, 23, 1, 54),
        datetime(2023, 3, 12, 2, 30, 15),
        None,
        None,
        None,
    ]


def test_rfc_time_and_offset(values):
    texts = ["Tue, 16 Nov 2021 11:52:00 -0500", "Sun, Mar 12 2023 4:52:00 -0400", "junk", None]
    assert values(lambda c: T.utc_clock(T.parse_rfc_time(c)), *texts) == [
        datetime(2021, 11, 16, 16, 52),
        datetime(2023, 3, 12, 8, 52),
        None,
        None,
    ]
    assert values(T.rfc_offset_minutes, *texts) == [-300, -240, None, None]
    assert values(T.parse_time, *texts)[:2] == [datetime(2021, 11, 16, 11, 52), datetime(2023, 3, 12, 4, 52)]


def test_other_forms(values):
    assert values(T.parse_time, "6/28/2022 17:40", "06/28/22 17:40:00", "2022-06-28 17:40:00") == [
        datetime(2022, 6, 28, 17, 40)
    ] * 3


def test_zone_abbreviation(values):
    got = values(T.zone_abbreviation, "Nov 23 2022, 1:54 am ChST", "Nov 16 2021, 11:52 am", "6/28/2022 17:40", None)
    assert got == ["CHST", None, None, None]


def test_session_zone_does_not_move_wall_clock(spark, values):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 on the day clocks go forward does not exist in New York, but does at other stations
        text = "Mar 12 2023, 2:30 am HST"
        got = values(lambda c: T.hour_floor(T.parse_local_time(c)).cast("string"), text)
        assert got == ["2023-03-12 02:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("day, hours", [(date(2023, 3, 12), 23), (date(2023, 11, 5), 25)])
def test_instants_on_clock_change_days(spark, day, hours):
    offsets = (-300, -240) if hours == 23 else (-240, -300)
    start, end = [
        datetime.combine(d, datetime.min.time()) - timedelta(minutes=o)
        for d, o in zip((day, day + timedelta(days=1)), offsets)
    ]
    df = spark.createDataFrame([(start, end)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(T.hour_diff("b", "a")).first()[0] == hours


def test_emit(spark):
    df = spark.createDataFrame([(datetime(2021, 11, 16, 9, 5, 7),)], "t timestamp_ntz")
    row = df.select(
        T.emit_time("t", "rfc", F.lit(-570)),
        T.emit_time("t", "reg", zone=F.lit("EST")),
        T.emit_time("t", "excel"),
        T.emit_time("t", "dt", F.lit(330)),
    ).first()
    assert tuple(row) == (
        "Tue, Nov 16 2021 9:05:07 -0930",
        "Nov 16 2021, 9:05:07 am EST",
        "11/16/21 09:05:07",
        "2021-11-16 09:05:07+05:30",
    )
    with pytest.raises(ValueError):
        T.emit_time("t", "rfc2")


def test_emitted_text_parses_back(spark):
    df = spark.createDataFrame([(datetime(2021, 12, 31, 23, 59, 1),)], "t timestamp_ntz")
    for kind in ("rfc", "reg", "excel", "dt"):
        text = T.emit_time("t", kind, F.lit(-600)) if kind == "rfc" else T.emit_time("t", kind)
        assert df.select(T.parse_time(text)).first()[0] == datetime(2021, 12, 31, 23, 59, 1)


def test_future_needs_more_than_one_hour(spark):
    base = datetime(2021, 1, 1, 10)
    rows = [(base + timedelta(hours=1), base), (base + timedelta(hours=1, seconds=1), base)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(T.is_future("a", "b")).collect()] == [False, True]


def test_months(values, spark):
    assert values(T.month_number, "January", "dec", "12", "13", "0", "bat", None) == [1, 12, 12, None, None, None, None]
    assert values(T.year_number, "2021", "1900", "9999", "x", None) == [2021, None, None, None, None]
    assert values(T.is_month, "March", "mar", "3", "x") == [True, True, False, False]
    df = spark.createDataFrame([(date(2021, 12, 31), date(2022, 2, 1))], "a date, b date")
    row = df.select(T.month_distance("a", "b"), T.month_distance("b", "a"), T.month_starts("a", "b")).first()
    assert tuple(row) == (2, 2, [date(2021, 12, 1), date(2022, 1, 1), date(2022, 2, 1)])


def test_dates(values):
    got = values(T.parse_date, "2021/5/1", "05/01/2021", "2021-05-01", "May 1 2021", "1 May 2021", "2021/02/30", "x")
    assert got == [date(2021, 5, 1)] * 5 + [None, None]
    shapes = ("Jan 29, 2021", "29 January 2021", "1/29/21", "01-29-2021", "2021-01-29T10:00", "jan. 29th 2021", "29-Jan-2021")
    assert values(T.parse_date, *shapes) == [date(2021, 1, 29)] * len(shapes)
    assert values(T.parse_date, "Sept 1 2021", "1/5/70", "1/5/69", None, "") == [date(2021, 9, 1), date(1970, 1, 5), date(2069, 1, 5), None, None]


def test_file_names(spark, values):
    df = spark.createDataFrame([(datetime(2021, 4, 9, 5, 59), date(2021, 5, 19))], "t timestamp_ntz, e date")
    k = F.lit("KDCA")
    row = df.select(T.file_key(k, "t"), T.range_file_key(k, "t", "e"), T.month_file_key(k, "t"), T.year_file_key(k, "t"))
    assert tuple(row.first()) == (
        "KDCA_Y2021_M04_D09_H05.csv",
        "KDCA_Y2021_M04_D09_H05_Range40.csv",
        "KDCA_Y2021_M04_D01_H00_Monthly.csv",
        "KDCA_Y2021_M01_D01_H00_Yearly.csv",
    )
    assert values(T.date_of_file, "KDCA_Y2021_M04_D09_H05.csv", "KDCA_Y2021_M13_D09_H05.csv", "KDCA_latest.csv") == [
        date(2021, 4, 9),
        None,
        None,
    ]


def test_local_now(spark):
    df = spark.createDataFrame([(-600,), (600,)], "o int")
    instant = F.lit(datetime(2022, 11, 20, 5, 54)).cast("timestamp")
    assert [r[0] for r in df.select(T.local_now("o", instant)).collect()] == [
        datetime(2022, 11, 19, 19, 54),
        datetime(2022, 11, 20, 15, 54),
    ]
