import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gustline.functions.text import NULL_TOKEN
from gustline.operators import dedup, project, quality
from gustline.schema import FIELDS, HISTORY_FIELDS
from gustline.sinks import tables
from gustline.sources import observations, textfiles

RECORD = """<?xml version="1.0" encoding="ISO-8859-1"?>
<current_observation version="1.0" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:noNamespaceSchemaLocation="x.xsd">
  <credit>Weather</credit><image><url>u</url><title>t</title></image><station_id>{st}</station_id><latitude>41.53</latitude>
  <observation_time>Last Updated on Mar 4 2023, 5:20 pm CST</observation_time>
  <observation_time_rfc822>Sat, 04 Mar 2023 17:20:00 -0600</observation_time_rfc822>
  <wind_dir>East</wind_dir><wind_mph>12.7</wind_mph><wind_gust_mph>31.9</wind_gust_mph><wind_kt>11</wind_kt>
  <relative_humidity>61</relative_humidity><visibility_mi>7.00</visibility_mi></current_observation>"""


def write(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(str(folder), name), "w", encoding=encoding, newline="") as f:
        f.write(text)


def csv_text(*rows):
    lines = [",".join(f'"{f}"' for f in FIELDS)]
    lines += [",".join(f'"{row.get(f, NULL_TOKEN)}"' for f in FIELDS) for row in rows]
    return "\n".join(lines) + "\n"


def test_xml_by_name_and_types(spark, tmp_path):
    write(tmp_path, "a.xml", RECORD.format(st="KDCA"))
    write(tmp_path, "empty.xml", "")
    write(tmp_path, "broken.xml", "<current_observation><wind_mph>1</wind_kt></current_observation>")
    rows = project.typed(observations.read_xml(spark, str(tmp_path))).collect()
    good = [r for r in rows if r["_corrupt_record"] is None]
    assert len(good) == 1 and len(rows) == 2
    row = good[0]
    # tag order differs from field order: values follow their names
    assert (row.wind_mph, row.wind_kt, row.wind_gust_mph, row.wind_gust_kt) == (12.7, 11.0, 31.9, None)
    assert (row.obs_local, row.tz_abbr, row.relative_humidity) == (datetime(2023, 3, 4, 17, 20), "CST", 61)
    assert row.observation_time == "Mar 4 2023, 5:20 pm CST" and row.latitude == 41.53
    assert row.heat_index_f is None


def test_parse_xml_column(spark):
    df = spark.createDataFrame([(1, RECORD.format(st="KDCA")), (2, ""), (3, "x"), (4, None)], "i int, xml string")
    rows = observations.parse_xml(df, "xml", ["i"]).orderBy("i").collect()
    assert [(r.i, r.station_id, r["_corrupt_record"]) for r in rows] == [(1, "KDCA", None), (2, None, ""), (3, None, "x"), (4, None, "")]


def test_canonical_keeps_order_and_fills(spark):
    df = project.canonical(spark.createDataFrame([("1", "K", "e")], "wind_mph string, station_id string, extra string"), ["extra"])
    assert df.columns == [*FIELDS, "extra"]
    assert df.first().asDict()["temp_f"] is None


def test_csv_range_reads_each_day_once(spark, tmp_path):
    for day in ("Y2020_M12_D30", "Y2020_M12_D31", "Y2021_M01_D01", "Y2021_M02_D01"):
        write(tmp_path, f"KDCA_{day}_H00.csv", csv_text({"station_id": "KDCA", "wind_mph": "5", "location": day}))
    write(tmp_path, "KDCA_Y2020_M12_D30_H00_Range3.csv", csv_text({"station_id": "KDCA", "location": "copy"}))
    write(tmp_path, "KIAD_Y2020_M12_D31_H00.csv", csv_text({"station_id": "KIAD", "location": "other"}))
    write(tmp_path, "KDCA_Y2020_M12_D29_H00.csv", csv_text())
    rows = observations.read_csv_range(spark, str(tmp_path), "KDCA", date(2020, 12, 29), date(2021, 1, 1)).collect()
    assert sorted(r["location"] for r in rows) == ["Y2020_M12_D30", "Y2020_M12_D31", "Y2021_M01_D01"]
    assert all(r.temp_f is None and r.collection_time is None for r in rows)
    month = observations.read_csv_month(spark, str(tmp_path), "KDCA", 2020, 12).collect()
    assert len(month) == 2
    names = observations.list_files(spark, str(tmp_path), observations.file_glob("KDCA", "csv", 2021)).orderBy("file_name")
    assert [(r.file_name, r.file_date) for r in names.collect()] == [
        ("KDCA_Y2021_M01_D01_H00.csv", date(2021, 1, 1)),
        ("KDCA_Y2021_M02_D01_H00.csv", date(2021, 2, 1)),
    ]


def test_csv_collection_time_newline_and_missing_path(spark, tmp_path):
    text = csv_text({"station_id": "K", "image": "\n\t ", "weather": "a, b"}).splitlines(keepends=True)
    text[0] = text[0].rstrip("\n") + ',"collection time"\n'
    text[-1] = text[-1].rstrip("\n") + ',"Nov 16 2021, 9:05:07 am"\n'
    write(tmp_path, "K_1.csv", "".join(text))
    rows = observations.read_csv(spark, str(tmp_path)).collect()
    assert [(r.station_id, r.weather, r.collection_time) for r in rows] == [("K", "a, b", "Nov 16 2021, 9:05:07 am")]
    assert observations.read_csv(spark, str(tmp_path / "absent")).count() == 0


def test_globs():
    assert observations.file_glob("KDCA") == "KDCA*.csv"
    assert observations.file_glob("A", "txt", 2021, 2, 3) == "A_Y2021_M02_D03_*.txt"
    assert observations.range_glob("K", date(2020, 12, 31), date(2021, 2, 1)) == "K_{Y2020_M12,Y2021_M01,Y2021_M02}_D*.csv"


def test_history_to_observations(spark):
    base = dict.fromkeys((*HISTORY_FIELDS, "Year", "Month", "station_id"))
    common = {"Year": "2021", "Month": "11", "Date": "16", "Time": "23:52", "station_id": "KDCA", "Air": "50", "Dwpt": "41", "Relative Humidity": "43%", "sea level (mb)": "1026.8", "altimeter (in)": "30.32", "Vis. (mi.)": "10.00", "Weather": "Fair"}
    rows = [base | common | {"Wind (mph)": "NW 8 G 25", "Wind Chill (°F)": "45"}, base | common | {"Wind (mph)": "Calm", "Heat Index (°F)": "90"}]
    schema = ", ".join(f"`{c}` string" for c in base)
    history = spark.createDataFrame([tuple(r[c] for c in base) for r in rows], schema)
    stations = spark.createDataFrame([("KDCA", "Washington", 38.8, -77.0, "EST", -300)], "station_id string, location string, latitude double, longitude double, tz_abbr string, offset_minutes int")
    history_frame = project.history_to_observations(history, stations)
    gusty, calm = history_frame.orderBy("wind_mph", ascending=False).collect()
    assert gusty.__fields__ == list(FIELDS)
    assert (gusty.observation_time, gusty.observation_time_rfc822) == ("Nov 16 2021, 11:52 PM EST", "Tue, Nov 16 2021 23:52:00 -0500")
    assert gusty.wind_string == "from the NorthWest at 8 gusting to 25 MPH (6.951808 KT gusting to 21.7244 KT)"
    assert (gusty.windchill_f, gusty.heat_index_c, gusty.relative_humidity) == ("45", None, "43%")
    assert (calm.wind_dir, calm.wind_mph, calm.wind_gust_kt, calm.wind_degrees) == ("North", "0", None, "0")
    assert gusty.temperature_string == "50 F (10.0008 C)" and gusty.windchill_string.startswith("45 F (7.22")
    assert project.typed(history_frame).orderBy("wind_mph").first().relative_humidity == 43
    # heat index in Celsius comes from the heat index, not from the wind chill
    assert round(float(calm.heat_index_c), 4) == 32.2248 and calm.windchill_c is None
    assert calm.two_day_history_url.endswith("/KDCA.html")


def test_positions(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert project.select_positions(df, [2, 0]).columns == ["c", "a"]
    assert project.select_positions(df, [9]).columns == ["a", "b", "c"]


def test_tides_across_years(spark, tmp_path):
    for year, lines in ((2021, "2021/12/31 Fri 11:15 PM 0.25 8 L\n"), (2022, "2022/01/01 Sat 05:01 AM 3.10 94 H\n2022/01/04 Tue 05:01 AM 3.10 94 H\n")):
        write(tmp_path, f"alex_Y{year}.txt", "Tide table\n" * 12 + "Date Day Time Pred(Ft) Pred(cm) High/Low\n" + lines)
    tides = textfiles.read_tides(spark, str(tmp_path / "alex_Y2021.txt"), str(tmp_path / "alex_Y2022.txt"))
    rows = tides.orderBy("date").collect()
    assert tuple(rows[0]) == (date(2021, 12, 31), "Fri", "11:15", "PM", 0.25, 8.0, "L", "11:15 PM")
    shown = tables.html_rows(quality.coming_hours(tides.withColumn("date", F.col("date").cast("timestamp_ntz")), "date", F.lit(date(2021, 12, 31))), ["tide_time", "pred_ft"])
    assert sorted(r.html for r in shown.collect())[0] == "<tr><td>05:01 AM</td><td>3.1</td></tr>" and shown.count() == 2
    assert tides.where(F.col("date").between(date(2021, 12, 31), date(2022, 1, 3))).count() == 2


def test_tracker_reports_changes_only(spark, tmp_path):
    head = '"observation_time" , "wind mph","collection time"\n'
    body = "".join(f'"{o}","5","Nov 16 2021, 9:{m:02d}:00 am"\n' for o, m in (("t1", 0), ("t1", 5), ("t2", 10), ("t2", 15), ("t3", 20)))
    write(tmp_path, "track.csv", head + body)
    rows = textfiles.read_tracker(spark, str(tmp_path / "track.csv"))
    assert rows.columns == ["observation_time", "wind_mph", "collection_time"]
    changed = dedup.change_only(rows.withColumn("st", F.lit("K")), "st", "observation_time", ["collection_time"])
    assert sorted(r.observation_time for r in changed.collect()) == ["t2", "t3"]


def test_lists_and_zones(spark, tmp_path):
    write(tmp_path, "obs.txt", "https://forecast.weather.gov/xml/current_obs/KDCA.xml\n\nhttps://forecast.weather.gov/xml/current_obs/PHOG.xml  \nhttps://stations.example.org/a/longer/path/current_obs/v2/KIAD.xml\n")
    assert [r.station_id for r in textfiles.read_station_list(spark, str(tmp_path / "obs.txt")).collect()] == ["KDCA", "PHOG", "KIAD"]
    write(tmp_path, "states.txt", "al\nAK\n\n")
    assert [r.state for r in textfiles.read_states(spark, str(tmp_path / "states.txt")).collect()] == ["AL", "AK"]
    zones = '"Abbr.","Name","UTC offset"\n"IST","Indian","UTC+05:30"\n"AET","x","UTC+10/UTC+11"\n"MST","y","UTC-07"\n"AZOST","z","UTC±00"\n'
    write(tmp_path, "tz.csv", zones, "iso-8859-1")
    rows = textfiles.read_zones(spark, str(tmp_path / "tz.csv")).orderBy("line_no").collect()
    assert [(r.abbr, r.offset_minutes) for r in rows] == [("IST", 330), ("AET", None), ("MST", -420), ("AZOST", 0)]


def test_blobs(spark, tmp_path):
    for name, text in (("ANZ535_Y2021_M01_D01_H00.txt", "a"), ("ANZ535_Y2021_M01_D01_H02.txt", "a"), ("ANZ535_Y2021_M01_D01_H04.txt", "b"), ("ANZ535_latest.txt", "b")):
        write(tmp_path, name, text)
    blobs = textfiles.read_blobs(spark, str(tmp_path), "ANZ535*.txt")
    assert blobs.count() == 3
    dups = dedup.consecutive_duplicates(blobs.select("station", "file_name", "md5"), "station", "md5", ["file_name"])
    assert [r.file_name for r in dups.collect()] == ["ANZ535_Y2021_M01_D01_H02.txt"]


OBS = [("KDCA", datetime(2021, 1, 1, 8, 52), 5.0), ("KDCA", datetime(2021, 1, 2, 8, 52), None), ("KIAD", datetime(2021, 1, 2, 9, 52), 7.0)]


@pytest.fixture
def obs(spark):
    return spark.createDataFrame(OBS, "station_id string, obs_local timestamp_ntz, wind_mph double")


def test_append_and_prune(spark, obs, tmp_path):
    path = str(tmp_path / "t")
    tables.append_observations(obs, path)
    tables.append_observations(obs.where("station_id = 'KIAD'").withColumn("obs_local", F.expr("obs_local + interval 1 hour")), path)
    got = observations.read_table_range(spark, path, date(2021, 1, 2), date(2021, 1, 3), "KIAD")
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_date" in plan and "EqualTo(station_id,KIAD)" in plan


def test_split_replaces_only_its_days(spark, obs, tmp_path):
    path = str(tmp_path / "s")
    tables.split_days(obs, path)
    tables.split_days(obs.where("station_id = 'KIAD'").withColumn("wind_mph", F.lit(9.0)), path, station="KIAD")
    rows = {(r.station_id, r.day): r.wind_mph for r in spark.read.parquet(path).collect()}
    assert rows == {("KDCA", 1): 5.0, ("KDCA", 2): None, ("KIAD", 2): 9.0}


def test_guarded_write_and_token(spark, obs, tmp_path):
    path = str(tmp_path / "g")
    rows = obs.select("station_id", F.col("wind_mph").cast("string"))
    tables.guarded_write(rows, path)
    tables.guarded_write(rows.limit(1), path)
    text = [r.value for r in spark.read.text(path).collect()]
    assert text.count('"KDCA","<no_value_provided>"') == 1 and '"station_id","wind_mph"' in text
    tables.guarded_write(rows.where("wind_mph = '5.0'"), path, force=True)
    assert {r.value for r in spark.read.text(path).collect()} == {'"KDCA","5.0"', '"station_id","wind_mph"'}
    tables.combine(rows, str(tmp_path / "c"), ["station_id", "wind_mph"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_latest_and_quarantine(spark, obs, tmp_path):
    tables.write_latest(obs, str(tmp_path / "l"), ["station_id"], ["obs_local"], ["obs_local", "wind_mph"])
    assert {(r.station_id, r.wind_mph) for r in spark.read.parquet(str(tmp_path / "l")).collect()} == {("KDCA", None), ("KIAD", 7.0)}
    tables.write_quarantine(obs.withColumn("is_suspect", F.col("wind_mph").isNull()), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_xml_round_trip(spark, obs, tmp_path):
    rows = obs.select("station_id", F.col("wind_mph").cast("string"), F.col("obs_local").cast("string").alias("observation_time"))
    tables.write_xml(rows, str(tmp_path / "x"))
    back = observations.read_xml(spark, str(tmp_path / "x"))
    assert {(r.station_id, r.wind_mph) for r in back.collect()} == {("KDCA", "5.0"), ("KDCA", None), ("KIAD", "7.0")}
    tables.write_xml(rows, str(tmp_path / "x1"), last_row_by=["observation_time"])
    assert observations.read_xml(spark, str(tmp_path / "x1")).count() == 2
    assert "<wind_mph/>" not in "".join(r.value for r in spark.read.text(str(tmp_path / "x")).collect())


def test_html_and_json(spark, obs, tmp_path):
    day = obs.withColumn("obs_date", F.to_date("obs_local"))
    tables.write_html(day, str(tmp_path / "h"), ["station_id", "obs_date"], ["obs_local"], ["obs_local", "wind_mph"])
    rows = spark.read.text(str(tmp_path / "h")).where("station_id = 'KDCA'").collect()
    assert len(rows) == 2 and any("&lt;no_value_provided&gt;" in r.value for r in rows)
    fragments = tables.html_fragments(day, ["station_id"], "obs_local", ["wind_mph"]).where("station_id = 'KDCA'").first()
    assert fragments.html == "<table><tr><td>5.0</td></tr><tr><td>&lt;no_value_provided&gt;</td></tr></table>"
    tables.write_json(tables.split_json(obs, ["station_id", "wind_mph"]).select("columns", "data"), str(tmp_path / "j"))
    assert {r["data"] for r in spark.read.json(str(tmp_path / "j")).collect()} == {'["KDCA",5.0]', '["KDCA",null]', '["KIAD",7.0]'}
    odd = spark.createDataFrame([(1, 'a "b"', float("nan"), True), (2, None, 1.5, None), (3, "", None, False)], "i int, s string, d double, b boolean")
    found = {r.i: json.loads(r["data"]) for r in tables.split_json(odd, ["s", "d", "b"]).collect()}
    assert found == {1: ['a "b"', None, True], 2: [None, 1.5, None], 3: ["", None, False]}
    whole = tables.split_json_objects(odd.withColumn("k", F.lit("K")), ["k"], "i", ["s", "d"]).first()
    assert json.loads(whole.json) == {"columns": ["s", "d"], "index": [1, 2, 3], "data": [['a "b"', None], [None, 1.5], ["", None]]}


def test_periods(spark):
    days = [datetime(2020, 12, 31, 23), datetime(2021, 1, 1), datetime(2021, 12, 31, 23, 59), datetime(2022, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    assert quality.period(df, "t", 2021).count() == 2
    assert quality.period(df, "t", 2021, 12).count() == 1
    assert quality.period(df, "t", 2020, 12, 31).count() == 1
