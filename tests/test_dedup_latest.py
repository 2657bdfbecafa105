from datetime import date, datetime

from pyspark.sql import functions as F

from gustline.operators import dedup, latest, lookups


def ids(df):
    return sorted(r.id for r in df.collect())


def test_highwater(spark):
    rows = [("K", 1, 10), ("K", 2, 10), ("K", 3, 9), ("K", 4, 11), ("L", 5, 1), ("K", 6, None)]
    df = spark.createDataFrame(rows, "station string, id int, t int")
    assert ids(dedup.highwater_accept(df, "station", "t", ["id"])) == [1, 4, 5]
    assert ids(dedup.highwater_accept(df, "station", "t", ["id"], ignore_dup=True)) == [1, 2, 3, 4, 5, 6]


def test_change_only(spark):
    rows = [("K", i, k) for i, k in enumerate(["a", "a", "b", None, None, "b", "a"])]
    df = spark.createDataFrame(rows, "station string, id int, k string")
    assert ids(dedup.change_only(df, "station", "k", ["id"])) == [2, 3, 5, 6]


def test_duplicates(spark):
    rows = [("K", i, c) for i, c in enumerate("aabba")]
    df = spark.createDataFrame(rows, "station string, id int, md5 string")
    assert ids(dedup.consecutive_duplicates(df, "station", "md5", ["id"])) == [1, 3]
    assert {(r.id, r.first_id) for r in dedup.any_duplicates(df, "md5", "id").collect()} == {(1, 0), (3, 2), (4, 0)}
    total = dedup.duplicate_summary(df, "station", F.col("id").isin(1, 3)).first()
    assert (total.n_files, total.n_duplicates) == (5, 2)


def test_a_third_of_all_rows_are_copies(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.md5(F.col("id").cast("string"))).alias("c"))
    docs = dedup.fingerprint_table(rows, "c", "id")
    found = dedup.any_duplicates(docs, "content_md5", "id")
    assert found.count() == 999 and {r.first_id for r in found.select("first_id").distinct().collect()} == {0}


def test_skip_unchanged_looks_back_one_day(spark):
    d = lambda n: date(2021, 1, n)
    stored = [("K", d(1), 1, "old"), ("K", d(1), 2, "A"), ("K", d(3), 1, "C")]
    stored = spark.createDataFrame(stored, "station string, day date, ts int, content string")
    incoming = [("K", d(1), "A", 1), ("K", d(2), "A", 2), ("K", d(2), "old", 3), ("K", d(3), "A", 4), ("K", d(5), "C", 5)]
    incoming = spark.createDataFrame(incoming, "station string, day date, content string, id int")
    assert ids(dedup.skip_unchanged(incoming, stored, "station", "day", "content", "ts")) == [3, 4, 5]


def test_latest_and_nth(spark):
    rows = [("K", 1, 5, "x"), ("K", 2, 7, "y"), ("K", 3, 7, "z"), ("L", 4, 1, "w")]
    df = spark.createDataFrame(rows, "station string, id int, t int, c string")
    assert {(r.station, r.c) for r in latest.latest_per_key(df, ["station"], ["t", "id"], ["c"]).collect()} == {("K", "z"), ("L", "w")}
    assert ids(latest.nth_row(df, ["station"], ["t", "id"], 2)) == [2]
    assert ids(latest.nth_row(df, ["station"], ["t", "id"], 1, newest_first=True)) == [3, 4]


def test_nth_row_of_a_hot_key_beyond_the_group_limit(spark):
    df = spark.range(9000).select(F.expr("if(id % 3 = 0, null, 'hot')").alias("station"), (F.col("id") % 7).alias("t"), "id")
    for newest in (False, True):
        want = []
        for hot in (True, False):
            rows = sorted(((r.t, r.id) for r in df.collect() if (r.station == "hot") == hot), reverse=newest)
            want.append(rows[1999][1])
        got = latest.nth_row(df, ["station"], ["t", "id"], 2000, newest_first=newest, rows_per_slice=500)
        assert ids(got) == sorted(want)


def test_asof(spark):
    rows = [("K", 1, date(2021, 1, 1)), ("K", 2, date(2021, 1, 3)), ("K", 3, date(2021, 1, 4))]
    df = spark.createDataFrame(rows, "station string, id int, d date")
    assert ids(latest.asof_latest(df, "station", "d", "id", ["id"], F.lit(date(2021, 1, 2)))) == [2]


def test_newest_file(spark):
    names = ["K_Y2021_M01_D03_H00.csv", "K_Y2021_M01_D05_H00.csv", "K_Y2021_M01_D09_H00.csv", "K_Y2020_M12_D31_H00.csv", "K_latest.csv"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    assert latest.newest_file(df, "file_name", F.lit(date(2021, 1, 6))).collect() == [("K", "K_Y2021_M01_D05_H00.csv")]


def test_fallback(spark):
    schema = "station string, hour int, arrival int, v string"
    primary = spark.createDataFrame([("K", 1, 5, "p"), ("K", 1, 4, "p0")], schema)
    alternate = spark.createDataFrame([("K", 1, 1, "a"), ("K", 2, 2, "b")], schema)
    rows = lookups.source_fallback(primary, alternate, ["station", "hour"], "arrival", ["v"]).orderBy("hour").collect()
    assert [(r.v, r.priority) for r in rows] == [("p0", 0), ("b", 1)]


def test_enrich_keeps_stations_without_observation(spark):
    stations = spark.createDataFrame([("K",), ("L",)], "station_id string")
    obs = spark.createDataFrame([("K", 1, 38.1), ("K", 2, 38.2)], "station_id string, t int, latitude double")
    rows = lookups.enrich_stations(stations, obs, "station_id", ["t"], ["latitude"]).orderBy("station_id").collect()
    assert [tuple(r) for r in rows] == [("K", 38.2), ("L", None)]


def test_fresh(spark):
    stations = spark.createDataFrame([("K",), ("L",)], "s string")
    files = spark.createDataFrame([("K", datetime(2021, 1, 3)), ("L", datetime(2021, 1, 1))], "s string, d timestamp_ntz")
    assert [r.s for r in lookups.fresh_keys(stations, files, "s", "d", F.lit(date(2021, 1, 9))).collect()] == ["K"]


def test_zone_lookup(spark):
    zones = [("AST", 180, 1), ("AST", -240, 2), ("GALT", -360, 3), ("GAMT", -540, 4), ("CHST", 600, 5)]
    zones = spark.createDataFrame(zones, "abbr string, offset_minutes int, line_no int")
    keys = ["EST", "AST", "ga", "ChST", "pm", "12", "none", None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, abbr string")
    got = lookups.zone_lookup(df.withColumnRenamed("abbr", "k"), "k", zones).orderBy("i").collect()
    assert [r.offset_minutes for r in got] == [-300, -240, -360, 600, None, None, None, None]
    plain = lookups.zone_lookup(df.withColumnRenamed("abbr", "k"), "k", zones, preferred=()).orderBy("i").collect()
    assert plain[1].offset_minutes == 180
