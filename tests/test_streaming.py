import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gustline.operators import dedup, project
from gustline.sources import observations
from gustline.streaming import ingest
from gustline.streaming.state import KeyedState, folders
from tests.test_sources_sinks import RECORD

SCHEMA = "station string, ts timestamp_ntz, arrival int, v double"


@pytest.fixture
def landing(spark, tmp_path):
    """Readings in arrival order, landed as four files of increasing age; one station holds a third."""
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    rows = [("hot" if i % 3 == 0 else f"s{rng.randrange(9)}", base + timedelta(hours=i // 6 + rng.randrange(-8, 8)), i, float(i % 17)) for i in range(600)]
    folder = str(tmp_path / "landing")
    for part in range(4):
        df = spark.createDataFrame(rows[part * 150 : part * 150 + 150], SCHEMA).coalesce(1)
        df.write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.startswith("part") and os.path.getmtime(path) > 1_700_000_100:
                os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    return folder, spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("size", [20, 10_000])
def test_highwater_stream_equals_batch(spark, landing, tmp_path, size):
    folder, batch = landing
    stream = ingest.table_stream(spark, folder, files_per_batch=1)
    names = [str(tmp_path / n) for n in ("out", "state", "cp")]
    ingest.start_highwater(stream, *names, "station", "ts", ["arrival"], rows_per_slice=size).awaitTermination()
    out = spark.read.parquet(names[0])
    assert out.select("batch_id").distinct().count() == 4
    want = dedup.highwater_accept(batch, "station", "ts", ["arrival"])
    assert rows_of(out, "station", "arrival") == rows_of(want, "station", "arrival")


def test_highwater_stream_resumes(spark, landing, tmp_path):
    folder, batch = landing
    names = [str(tmp_path / n) for n in ("out", "state", "cp")]
    run = lambda: ingest.start_highwater(
        ingest.table_stream(spark, folder, files_per_batch=2), *names, "station", "ts", ["arrival"]
    ).awaitTermination()
    run()
    run()
    late = spark.createDataFrame([("hot", datetime(2023, 1, 1), 900, 1.0), ("hot", datetime(2025, 1, 1), 901, 1.0)], SCHEMA)
    late.coalesce(1).write.mode("append").parquet(folder)
    run()
    want = dedup.highwater_accept(batch.unionByName(late), "station", "ts", ["arrival"])
    assert rows_of(spark.read.parquet(names[0]), "station", "arrival") == rows_of(want, "station", "arrival")


def test_highwater_stream_survives_a_failed_batch(spark, landing, tmp_path, monkeypatch):
    folder, batch = landing
    names = [str(tmp_path / n) for n in ("out", "state", "cp")]
    run = lambda: ingest.start_highwater(
        ingest.table_stream(spark, folder, files_per_batch=1), *names, "station", "ts", ["arrival"]
    ).awaitTermination()
    write = KeyedState.write

    def failing(state, df, batch_id):
        if batch_id == 2:
            raise RuntimeError("lost after the output, before the state")
        write(state, df, batch_id)

    monkeypatch.setattr(KeyedState, "write", failing)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.setattr(KeyedState, "write", write)
    run()
    want = dedup.highwater_accept(batch, "station", "ts", ["arrival"])
    assert rows_of(spark.read.parquet(names[0]), "station", "arrival") == rows_of(want, "station", "arrival")


@pytest.mark.parametrize("files", [1, 10])
def test_tumbling_stream_equals_batch(spark, landing, tmp_path, files):
    folder, batch = landing
    stream = ingest.table_stream(spark, folder, files_per_batch=files)
    out = str(tmp_path / "out")
    ingest.start_tumbling(stream, out, str(tmp_path / "cp"), "station", "ts", "v").awaitTermination()
    got = rows_of(ingest.read_tumbling(spark, out, "station"), "station", "n_rows", "max_value", "min_value")
    want = batch.groupBy("station", F.to_date("ts")).agg(F.count("*").alias("n"), F.max("v").alias("a"), F.min("v").alias("b"))
    assert got == rows_of(want, "station", "n", "a", "b")


@pytest.mark.parametrize("files", [1, 10])
def test_content_change_stream(spark, tmp_path, files):
    """Every change counts, whatever the batches: A, A, B, A of a station, and one without a name."""
    folder = str(tmp_path / "in")
    names = [str(tmp_path / n) for n in ("out", "state", "cp")]
    for t, content in enumerate(["a", "a", "b", "a", None, None]):
        rows = [("K", content, 2 * t), (None, "same", 2 * t + 1)]
        spark.createDataFrame(rows, "station string, content string, t int").coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        stream = ingest.table_stream(spark, folder, files_per_batch=files)
        ingest.start_content_change(stream, *names, "station", "content", ["t"]).awaitTermination()
    found = [tuple(r) for r in spark.read.parquet(names[0]).select("station", "content", "t").orderBy("t").collect()]
    assert found == [("K", "a", 0), (None, "same", 1), ("K", "b", 4), ("K", "a", 6), ("K", None, 8)]
    if files == 1:
        assert all(len(folders(spark, p, "version=")) == 2 for p in folders(spark, names[1], "bucket=").values())


@pytest.mark.parametrize("files", [1, 10])
def test_clean_ingest_loses_no_row(spark, landing, tmp_path, files):
    """Late rows go to a table of their own; both tables are the same for one and for ten files per batch."""
    folder, batch = landing
    names = [str(tmp_path / n) for n in ("table", "late", "state", "cp")]
    stream = ingest.table_stream(spark, folder, files_per_batch=files)
    ingest.start_clean_ingest(stream, *names, "station", "ts", ["arrival"]).awaitTermination()
    high, seen, table, late = {}, set(), [], []
    for r in batch.orderBy("arrival").collect():
        if r.station in high and r.ts < high[r.station] - timedelta(hours=2):
            late.append((r.station, r.arrival))
        elif (r.station, r.ts) not in seen:
            table.append((r.station, r.arrival))
            seen.add((r.station, r.ts))
        high[r.station] = max(r.ts, high.get(r.station, r.ts))
    assert rows_of(spark.read.parquet(names[0]), "station", "arrival") == sorted(table)
    assert rows_of(spark.read.parquet(names[1]), "station", "arrival") == sorted(late) and late


@pytest.mark.parametrize("files", [1, 10])
def test_late_days_are_counted(spark, tmp_path, files):
    folder = str(tmp_path / "in")
    for i, day in enumerate((10, 11, 5, 12)):
        rows = [("K", datetime(2024, 1, day, 8), i, 1.0)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.table_stream(spark, folder, files_per_batch=files)
    ingest.start_tumbling(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "station", "ts", "v").awaitTermination()
    assert ingest.read_tumbling(spark, str(tmp_path / "out"), "station").count() == 4
    names = [str(tmp_path / n) for n in ("table", "late", "state", "cp2")]
    stream = ingest.table_stream(spark, folder, files_per_batch=files)
    ingest.start_clean_ingest(stream, *names, "station", "ts", ["arrival"]).awaitTermination()
    assert [spark.read.parquet(n).count() for n in names[:2]] == [3, 1]


def test_highwater_stream_remembers_a_station_without_a_name(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i, hour in enumerate((5, 3)):
        rows = [(None, datetime(2024, 1, 1, hour), i, 1.0)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    names = [str(tmp_path / n) for n in ("out", "state", "cp")]
    stream = ingest.table_stream(spark, folder, files_per_batch=1)
    ingest.start_highwater(stream, *names, "station", "ts", ["arrival"]).awaitTermination()
    assert spark.read.parquet(names[0]).count() == 1


def test_xml_ingest_with_quarantine_and_resume(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    landing.mkdir()

    def land(name, station, **replaced):
        text = RECORD.format(st=station)
        for old, new in replaced.values():
            text = text.replace(old, new)
        (landing / name).write_text(text)

    def run():
        typed = project.typed(observations.stream_xml(spark, str(landing))).where("_corrupt_record is null")
        records = ingest.clean_records(typed, "station_id", "obs_local", ("wind_mph", "wind_dir"))
        records = records.withColumn("obs_date", F.to_date("obs_local"))
        ingest.start_ingest(records, table, str(tmp_path / "cp")).awaitTermination()
        ingest.start_quarantine(records, str(tmp_path / "bad"), str(tmp_path / "cp2")).awaitTermination()

    land("1.xml", "KDCA")
    land("2.xml", "KDCA")
    land("3.xml", "KIAD", wind=("<wind_mph>12.7</wind_mph>", ""))
    run()
    land("4.xml", "KDCA")
    land("5.xml", "KDCA", t=("5:20 pm", "6:20 pm"))
    run()
    got = spark.read.parquet(table)
    assert rows_of(got, "station_id", "obs_local") == [
        ("KDCA", datetime(2023, 3, 4, 17, 20)),
        ("KDCA", datetime(2023, 3, 4, 18, 20)),
        ("KIAD", datetime(2023, 3, 4, 17, 20)),
    ]
    assert rows_of(spark.read.parquet(str(tmp_path / "bad")), "station_id") == [("KIAD",)]


def test_late_rule(spark):
    t = datetime(2021, 1, 2, 1, 0)
    rows = [(1, datetime(2021, 1, 2, 0, 52), t), (2, datetime(2021, 1, 1, 23, 52), t), (3, datetime(2021, 1, 1, 22, 52), t), (4, datetime(2020, 12, 2, 5, 0), t)]
    df = spark.createDataFrame(rows, "id int, o timestamp_ntz, n timestamp_ntz")
    assert sorted(r.id for r in ingest.drop_late(df, "o", F.col("n")).collect()) == [1, 2]
    assert sorted(r.id for r in ingest.late_rows(df, "o", F.col("n")).collect()) == [3, 4]
    day = F.lit("2021-01-02").cast("date")
    assert sorted(r.id for r in ingest.late_rows(df, "o", F.col("n"), day).collect()) == [2, 3, 4]
    assert [r.id for r in ingest.drop_late(df, "o", F.col("n"), day).collect()] == [1]


def test_state_is_kept_per_bucket_and_survives_a_rerun(spark, tmp_path):
    schema = "_station string, _stored int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = lambda: KeyedState(spark, str(tmp_path / "state"), schema, "_station")
    everyone = [(f"s{i}", 0) for i in range(200)] + [(None, 0)]
    first = table()
    assert first.read(frame(everyone), "_station", 0).count() == 0
    first.write(frame(everyone), 0)
    for batch_id in (1, 2, 2, 3):
        one = table()
        seen = one.read(frame([("s7", 0)]), "_station", batch_id)
        assert {r._station: r._stored for r in seen.collect()}["s7"] == (0 if batch_id == 1 else batch_id - 1)
        assert seen.count() < 30
        one.write(seen.withColumn("_stored", F.when(F.col("_station") == "s7", batch_id).otherwise(F.col("_stored"))), batch_id)
    versions = {b: sorted(int(v) for v in folders(spark, p, "version=")) for b, p in folders(spark, str(tmp_path / "state"), "bucket=").items()}
    assert sorted(map(tuple, versions.values()))[-1] == (2, 3) and sum(v == [0] for v in versions.values()) == len(versions) - 1
    last = table()
    got = {r._station: r._stored for r in last.read(frame(everyone), "_station", 4).collect()}
    assert got == {s: 3 if s == "s7" else 0 for s, _ in everyone}


def test_tumbling_shares_are_folded_and_rows_without_time_are_kept(spark, landing, tmp_path):
    folder, batch = landing
    spark.createDataFrame([("hot", None, 900, 5.0), (None, None, 901, None)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    want = batch.groupBy("station", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.max("v").alias("hi"))
    for fold, undated in ((1, None), (2, str(tmp_path / "undated")), (64, None)):
        out = str(tmp_path / f"out{fold}")
        stream = ingest.table_stream(spark, folder, files_per_batch=1)
        ingest.start_tumbling(stream, out, str(tmp_path / f"cp{fold}"), "station", "ts", "v", undated=undated, fold=fold).awaitTermination()
        got = ingest.read_tumbling(spark, out, "station").withColumn("d", F.to_date(F.timestamp_micros("window_micros")))
        timed = got.where("window_micros is not null")
        assert rows_of(timed, "station", "d", "n_rows", "max_value") == rows_of(want, "station", "d", "n", "hi")
        others = sorted((r.station or "", r.n_rows, r.max_value) for r in got.where("window_micros is null").collect())
        assert others == ([] if undated else [("", 1, None), ("hot", 1, 5.0)])
        assert len(folders(spark, out, "batch_id=")) == {1: 1, 2: 2, 64: 5}[fold] and len(folders(spark, out, "upto=")) == {1: 1, 2: 1, 64: 0}[fold]
        if undated:
            assert spark.read.parquet(undated).count() == 2
