import random
import warnings
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from gustline.functions.dates import parse_date
from gustline.functions.times import wall_clock
from gustline.operators import zones
from gustline.plans.times import date_coercion

FORMS = (
    "%a, %d %b %Y %H:%M:%S -0500", "%d.%m.%Y", "%Y.%m.%d", "%Y%m%dT%H%M", "%Y%m%dT%H%M%S", "%d/%m/%Y", "%Y-%m-%d %I%p",
    "%Y-%m-%d %I:%M %p", "%A, %B %d, %Y", "%b %d %Y", "%d-%b-%Y", "%d-%b-%y", "%Y %b %d", "%Y%m%d", "%Y%m%d%H%M", "%y%m%d",
    "%B %d, %Y, %I:%M %p EST", "%Y-%m-%dT%H:%M:%S.123Z", "%Y-%m-%dT%H:%M:%S+05:30", "%a %b %d %H:%M:%S %Y", "%dth of %B %Y", "%m/%d/%y",
    "%b %d '%y", "%Y/%m/%d", "%m-%d-%Y", "%d %b, %Y", "at %H:%M on %d %b %Y",
)


def test_dates_like_the_usual_parser(values):
    parser = pytest.importorskip("dateutil.parser")
    rng, texts, want = random.Random(3), [], []
    for i in range(1500):
        # two-digit years of the other century are told apart by a rule of our own
        moment = datetime(2000, 1, 1) + timedelta(minutes=rng.randrange(15_000_000))
        text = moment.strftime(FORMS[i % len(FORMS)])
        texts.append(text.upper() if rng.random() < 0.2 else text)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                want.append(parser.parse(texts[-1]).date())
            except parser.ParserError:
                want.append(None)
    got = values(parse_date, *texts)
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_partial_and_broken_dates(values):
    texts = {
        "Jan 2021": date(2021, 1, 1), "2021": date(2021, 1, 1), "01/2021": date(2021, 1, 1), "2021-05": date(2021, 5, 1),
        "13/01/2021": date(2021, 1, 13), "2021-01-29 8pm": date(2021, 1, 29), "20210129T1200": date(2021, 1, 29), "29.01.2021": date(2021, 1, 29),
        "Feb 29 2024": date(2024, 2, 29), "Feb 29 2023": None, "2021-13-45": None, "31/31/2021": None, "Jan": None, "29": None, "Jan 29": None,
        "Jan Feb 2021": None, "12 Jan 2021 x": None, "9" * 30: None, "10:30": None, "%": None, "1-URGENT": None, "": None, "5/1/70": date(1970, 5, 1),
        "5/1/69": date(2069, 5, 1), "0000-01-01": None, "é 2021": None, "1 2 3 4": None, " " * 200 + "2021-01-01": date(2021, 1, 1), "1 " * 60: None,
    }
    assert dict(zip(texts, values(parse_date, *texts), strict=True)) == texts
    assert values(parse_date, None) == [None]


def test_tokens_beside_each_other(values):
    texts = {
        "5t1234567 jan 2021": None, "20210129t120000 10 a.m.": date(2021, 1, 29), "29jan2021t10:30": date(2021, 1, 29), "t 2021": None, "janx 2021": None,
        "sept. 5 2021": date(2021, 9, 5), "2021 10 am jan": date(2021, 1, 1), "08:52:00 -0500 29 jan 2021": date(2021, 1, 29), "jan 5 1 2 2021": None,
        "t\t123456789012345": None, "10 pm": None, "at 10:20": None, "123456789 jan 5": None, "$1 jan 2021": None, "mayday 2021": None, "may/5/21": date(2021, 5, 5),
    }
    assert dict(zip(texts, values(parse_date, *texts), strict=True)) == texts


def test_a_file_of_one_row_group_is_parsed_in_many_tasks(spark, tmp_path):
    days = [(i, datetime(2021, 1, 1) + timedelta(days=i % 400), "1-URGENT") for i in range(300)]
    spark.createDataFrame(days, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    parsed = date_coercion(spark, str(tmp_path))
    assert parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {r.o_orderkey: (r.from_rfc, r.from_compact, r.from_pm, r.from_junk) for r in parsed.collect()}
    assert got == {i: (day.date(), day.date(), day.date(), None) for i, day, _ in days}


ZONES = ("America/New_York", "Australia/Sydney", "Australia/Lord_Howe", "Asia/Kathmandu", "UTC", "America/Phoenix")


@pytest.fixture(scope="module")
def named(spark):
    return spark.createDataFrame([(z,) for z in ZONES], "zone string")


def clocks():
    rng, rows = random.Random(9), [(0, None, datetime(2020, 1, 1)), (1, "America/New_York", None), (2, "No/Where", datetime(2020, 1, 1))]
    edges = [datetime(2020, 3, 8, 2), datetime(2020, 11, 1, 1), datetime(2020, 4, 5, 2), datetime(2020, 10, 4, 2), datetime(2019, 12, 31, 23)]
    for i in range(900):
        at = rng.choice(edges) + timedelta(minutes=rng.randrange(-90, 150)) if i % 2 else datetime(2019, 1, 1) + timedelta(minutes=rng.randrange(1_050_000))
        rows.append((10 + i, rng.choice(ZONES), at))
    return rows


def expected(zone, at):
    early, late = (at.replace(tzinfo=ZoneInfo(zone), fold=f).utcoffset() for f in (0, 1))
    if early == late:
        return "plain", early, late
    # Python reads a missing hour with the offset before the change; here it is the one after it
    return ("overlap", early, late) if early > late else ("gap", late, late)


@pytest.mark.parametrize("later", [False, True])
def test_offsets_of_wall_clocks(spark, named, later):
    rows = clocks()
    df = spark.createDataFrame(rows, "i int, zone string, wall timestamp_ntz")
    found = zones.offset_at_wall_clock(df, "zone", "wall", zones.wall_spans(named, 2019, 2020), later)
    got = {r.i: (r.zone_kind, r.offset_minutes) for r in found.collect()}
    assert len(got) == len(rows) and [got[i] for i in range(3)] == [(None, None)] * 3
    for i, zone, at in rows[3:]:
        kind, early, late = expected(zone, at)
        assert got[i] == (kind, int((late if later else early).total_seconds() // 60)), (zone, at)


def test_wall_clocks_of_instants(spark, named):
    rows = clocks()
    df = spark.createDataFrame(rows, "i int, zone string, at timestamp_ntz")
    spans = zones.instant_spans(named, 2019, 2020)
    got = {r.i: r.local_time for r in zones.wall_clock_at(df, "zone", "at", spans).collect()}
    stamps = df.withColumn("at", F.timestamp_micros(F.timestamp_diff("MICROSECOND", wall_clock(F.lit(0)), F.col("at"))))
    assert {r.i: r.local_time for r in zones.wall_clock_at(stamps, "zone", "at", spans).collect()} == got
    for i, zone, at in rows[3:]:
        assert got[i] == at.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).replace(tzinfo=None), (zone, at)


def test_segments_of_a_zone_have_no_holes(named):
    for spans in (zones.wall_spans(named, 1990, 1995), zones.instant_spans(named, 1990, 1995)):
        by_zone = {}
        for r in spans.select("zone", "low", "high").distinct().orderBy("zone", "low").collect():
            by_zone.setdefault(r.zone, []).append((r.low, r.high))
        assert set(by_zone) == set(ZONES)
        for found in by_zone.values():
            assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
