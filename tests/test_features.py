"""Late merge, indexed station reads, trends, sketches, templates and unknown fields on small fixtures."""

import random
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustline.operators import sketches, trend
from gustline.sinks import tables, xmltemplate
from gustline.sources import extra, observations

ROW = "station_id string, obs_local timestamp_ntz, value int, arrival int"


def rows_of(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("station_id", "obs_local", "value", "arrival").collect())


def feed(seed, n=400):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(rng.choice("ABC"), start + timedelta(hours=rng.randrange(24 * 9)), i, i) for i in range(n)]


def first_of_all(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r[3]):
        found.setdefault((r[0], r[1]), r)
    return sorted(found.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_late_merge_equals_ingest_in_order(spark, tmp_path, seed):
    rows, path = feed(seed), str(tmp_path / "t")
    rng = random.Random(seed)
    late = [r for r in rows if rng.random() < 0.3]
    tables.merge_late(spark.createDataFrame([r for r in rows if r not in late], ROW), path, ["arrival"])
    for part in (late[:40], late[40:], late[40:]):
        days = tables.merge_late(spark.createDataFrame(part, ROW), path, ["arrival"])
    assert days == 0 and rows_of(spark, path) == first_of_all(rows)


def test_late_merge_touches_only_days_that_change(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = feed(3)
    tables.merge_late(spark.createDataFrame(rows, ROW), path, ["arrival"])
    before = set(spark.read.parquet(path).inputFiles())
    new = [("Z", datetime(2024, 1, 3, 5), 1, 9000), ("Z", datetime(2024, 2, 1), 1, 9001), (rows[0][0], rows[0][1], 7, 9002)]
    assert tables.merge_late(spark.createDataFrame(new, ROW), path, ["arrival"]) == 2
    gone = before - set(spark.read.parquet(path).inputFiles())
    assert gone and all("2024-01-03" in f for f in gone)
    assert rows_of(spark, path) == first_of_all([*rows, *new])
    # an empty table of late rows, and rows without station or time
    assert tables.merge_late(spark.createDataFrame([], ROW), path, ["arrival"]) == 0
    odd = spark.createDataFrame([(None, datetime(2024, 1, 3, 5), 1, 1), ("A", None, 2, 2)], ROW)
    assert [tables.merge_late(odd, path, ["arrival"]) for _ in range(2)] == [2, 0]
    assert spark.read.parquet(path).count() == len(first_of_all([*rows, *new])) + 2


def scanned_rows(df):
    """Rows that the file scan of an executed plan gave."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return sum(found)


def test_reading_one_station_skips_row_groups_and_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    hours = spark.range(200 * 24 * 4).select(
        F.concat(F.lit("S"), F.lpad((F.col("id") % 200).cast("string"), 3, "0")).alias("station_id"),
        F.timestamp_add("HOUR", (F.col("id") / 200).cast("int"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).alias("obs_local"),
    )
    spark.conf.set("parquet.block.size", "4096")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "4096")
    spark._jsc.hadoopConfiguration().set("parquet.block.row.count.limit", "500")
    try:
        tables.append_observations(hours, path)
    finally:
        for name in ("parquet.block.size", "parquet.block.row.count.limit"):
            spark._jsc.hadoopConfiguration().unset(name)
        spark.conf.unset("parquet.block.size")
    one = observations.read_table_range(spark, path, date(2024, 1, 2), date(2024, 1, 3), "S117")
    assert one.count() == 48
    # two days hold 9,600 rows
    assert 48 <= scanned_rows(one) <= 2 * 1000
    none = observations.read_table_range(spark, path, date(2024, 1, 1), date(2024, 1, 4), "S117x")
    assert none.count() == 0 and scanned_rows(none) <= 4 * 500


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_trend_of_any_order_equals_a_fit(spark, order):
    rng = random.Random(order)
    rows = [("A", datetime(2024, 1, 1) + timedelta(minutes=m), rng.uniform(-20, 30)) for m in rng.sample(range(1440), 60)]
    rows += [("A", datetime(2024, 1, 2, 3), 1.0), ("A", datetime(2024, 1, 2, 4), None), (None, None, 2.0), ("A", datetime(2024, 1, 3, 3), 1.0)] * 2
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, value double")
    got = {(r.station, r.obs_date): r for r in trend.daily_trend(df, "station", "ts", "value", order).collect()}
    x = [(r[1] - datetime(2024, 1, 1)).total_seconds() / 86400 for r in rows[:60]]
    assert got["A", date(2024, 1, 1)].slope == pytest.approx(np.polyfit(x, [r[2] for r in rows[:60]], order)[-2], rel=1e-4, abs=1e-4)
    assert got["A", date(2024, 1, 2)].slope is None and got["A", date(2024, 1, 2)].n_obs == 2
    assert set(got) == {("A", date(2024, 1, d)) for d in (1, 2, 3)}


def test_moments_of_parts_merge(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id % 7 AS part", "(id % 100) / 100.0D - 0.5D AS x", "id * id * 0.01D AS y")
    parts = trend.moments(df, ["k", "part"], F.col("x"), F.col("y"), 2)
    whole = trend.moments(df, ["k"], F.col("x"), F.col("y"), 2)
    merged = trend.merged_moments(parts, ["k"], 2)
    for a, b in zip(merged.orderBy("k").collect(), whole.orderBy("k").collect(), strict=True):
        assert a.n == b.n and a.xs == pytest.approx(b.xs) and a.xys == pytest.approx(b.xys)


def test_sketches_stay_within_their_errors(spark):
    df = spark.range(400_000).selectExpr(
        "cast(id % 2 AS string) AS station", "timestamp_ntz'2024-01-30 00:00:00' + make_dt_interval(0, cast(id % 96 AS int)) AS ts",
        "cast(pmod(xxhash64(id), 60000) AS double) AS value",
    )
    days = sketches.daily_sketches(df, "station", "ts", "value")
    assert days.count() == 8
    got = {(r.station, r.period): r for r in sketches.range_profile(days, date(2024, 1, 30), date(2024, 2, 2), {"q1": 0.1, "q5": 0.5}).collect()}
    assert set(got) == {(s, p) for s in "01" for p in ("2024-01", "2024-02", "range")}
    for station in "01":
        r = got[station, "range"]
        assert r.n_rows == r.n_values == 200_000
        assert r.q1 == pytest.approx(6_000, abs=60_000 * 0.003) and r.q5 == pytest.approx(30_000, abs=60_000 * 0.003)
        exact = df.where(F.col("station") == station).select("value").distinct().count()
        assert r.n_distinct == pytest.approx(exact, rel=0.03)


def test_sketches_of_odd_rows(spark):
    rows = [("A", datetime(2024, 1, 1), None), (None, datetime(2024, 1, 1), 1.0), ("B", None, 2.0), ("C", datetime(2024, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, value double")
    days = sketches.daily_sketches(df, "station", "ts", "value")
    assert days.count() == 4
    got = {r.station: r for r in sketches.range_profile(days, date(2024, 1, 1), date(2024, 1, 1), {"q": 0.5}).where("period = 'range'").collect()}
    assert (got["A"].q, got["A"].mean_value, got["A"].n_distinct, got["A"].n_rows) == (None, None, 0, 1)
    assert (got[None].q, got["C"].q) == (1.0, 3.0) and "B" not in got
    assert sketches.range_profile(days.limit(0), date(2024, 1, 1), date(2024, 1, 1), {"q": 0.5}).count() == 0


TEMPLATE = """<?xml version="1.0" encoding="ISO-8859-1"?>
<!-- records -->
<r:current_observation xmlns:r="urn:r" version="1.0" note="a &lt; &quot;b&quot;">
  <credit>Me &amp; you</credit><station_id/>
  <image><url>u</url><link/></image>
  <temp_f>1</temp_f>
  <only><inner>x</inner></only>
</r:current_observation>"""


def test_template_order_attributes_and_left_out_elements(spark):
    df = spark.createDataFrame([("K<1>&", 1.5, "i"), (None, None, None), (" ", 2.0, "")], "s string, t double, inner string")
    made = xmltemplate.compile_template(TEMPLATE, {"station_id": "s", "temp_f": "t", "only/inner": "inner"})
    texts = [r[0] for r in df.select(made).collect()]
    roots = [ElementTree.fromstring(x.encode()) for x in texts]
    assert all(r.tag == "{urn:r}current_observation" and r.attrib == {"version": "1.0", "note": 'a < "b"'} for r in roots)
    assert [[c.tag for c in r] for r in roots] == [
        ["credit", "station_id", "image", "temp_f", "only"], ["credit", "image"], ["credit", "image", "temp_f"]
    ]
    assert roots[0].find("station_id").text == "K<1>&" and roots[0].find("only/inner").text == "i" and roots[0].find("credit").text == "Me & you"
    assert [c.tag for c in roots[0].find("image")] == ["url"]
    assert texts[0].index("<!-- records -->") < texts[0].index("current_observation") and "\n  \n" not in texts[1]
    bare = df.select(xmltemplate.compile_template(TEMPLATE, {"temp_f": "t"}, keep_fixed=False)).first()[0]
    assert [c.tag for c in ElementTree.fromstring(bare.encode())] == ["temp_f"]
    with pytest.raises(ValueError, match="no_such"):
        xmltemplate.compile_template(TEMPLATE, {"no_such": "s"})


def test_template_records_are_named(spark):
    df = spark.createDataFrame([("KDCA", datetime(2021, 1, 29, 8, 52))], "station_id string, obs_local timestamp_ntz")
    row = xmltemplate.template_records(df, "<a><station_id>x</station_id></a>", {"station_id": "station_id"}, "station_id", "obs_local").first()
    assert row.file_name == "KDCA_Y2021_M01_D29_H08.xml" and row.xml == "<a><station_id>KDCA</station_id></a>"


def test_unknown_fields_are_kept_and_promoted(spark):
    head, tail = "<current_observation><station_id>K</station_id>", "</current_observation>"
    xml = [
        f"{head}<uv>4</uv><road><state>wet</state></road><x>a</x><x>b</x>{tail}", f"{head}<temp_f>3</temp_f>{tail}", f"{head}<uv>high</uv>{tail}",
        "<current_observation><sta", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(xml)), "i int, xml string")
    kept = extra.parse_xml_with_extra(df, "xml", ["i"])
    assert "xml" not in kept.columns
    rows = {r.i: r for r in kept.withColumn("text", F.to_json("extra_fields")).collect()}
    assert rows[0].text == '{"road":{"state":"wet"},"uv":4,"x":["a","b"]}' and [rows[i].text for i in (1, 3, 4, 5)] == [None] * 4
    assert rows[0].station_id == "K" and rows[1].temp_f == "3" and rows[3]._corrupt_record is not None
    wide = extra.promoted(kept, {"uv": "int", "absent": "string"}).orderBy("i").collect()
    assert [r.uv for r in wide] == [4, None, None, None, None, None] and all(r.absent is None for r in wide)
    assert {r.name: r.n_rows for r in extra.extra_names(kept).collect()} == {"uv": 2, "road": 1, "x": 1}


def test_unknown_csv_columns(spark):
    df = spark.createDataFrame([("K", "1", "a", None), ("L", None, None, None)], "station_id string, temp_f string, `new col` string, other string")
    kept = extra.csv_with_extra(df)
    assert kept.columns == ["station_id", "temp_f", "extra_fields"]
    assert [r[0] for r in kept.select(F.to_json("extra_fields")).collect()] == ['{"new col":"a"}', None]
    assert extra.promoted(kept, {"new col": "string"}).first()["new col"] == "a"
    assert extra.csv_with_extra(df.select("station_id")).first().extra_fields is None


def test_files_by_name_and_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([("A_Y2024_M01_D03_H00.csv", "x"), ("A_Y2024_M02_D03_H00.csv", "y"), ("A_latest.csv", "z"), ("B_Y2024_M01_D03_H00.csv", "x")], "n string, b string")
    tables.write_named_files(rows, str(tmp_path / "f"), "n", "b")
    found = observations.list_files(spark, str(tmp_path / "f"), observations.range_glob("A", date(2024, 1, 1), date(2024, 1, 31)), by_folder=True)
    assert [(r.file_name, r.file_date) for r in found.collect()] == [("A_Y2024_M01_D03_H00.csv", date(2024, 1, 3))]
    assert observations.glob_pattern("a.b*{c,d}?") == r"^a\.b.*(?:c|d).$"
