"""Absence timers and stream pairs against the batch rules, for any cut of the feed into batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gustline.functions.times import hour_floor
from gustline.operators import lookups
from gustline.streaming import fallback, ingest

SCHEMA = "i long, station string, ts timestamp_ntz, value double, priority int, arrival long"
COLUMNS = ["i", "station", "ts", "value", "priority"]


def feed(seed, n=160):
    """Rows that come up to two hours late, and one far behind them."""
    rng, start, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        ts = start + timedelta(minutes=rng.randrange(60 * 24))
        value = None if rng.random() < 0.1 else rng.uniform(0, 9)
        rows.append((i, rng.choice(["A", "B", None]), ts, value, rng.choice([0, 1, 1]), int((ts - start).total_seconds() // 60) + rng.randrange(120)))
    rows.sort(key=lambda r: (r[5], r[0]))
    end = start + timedelta(days=4)
    return rows, [(1000 + p, "tick", end, 0.0, p, 10**6) for p in (0, 1)] + [(2000, "A", None, 1.0, 0, 10**6)]


def run(spark, folder, parts, start):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part-{k}")
        start(lambda: ingest.table_stream(spark, f"{folder}/in", recursive=True)).awaitTermination()


def cut(rows, n):
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


@pytest.mark.parametrize("batches", [1, 3])
def test_alternate_comes_through_when_the_hour_has_no_primary(spark, tmp_path, batches):
    rows, last = feed(batches)
    store = spark.conf.get(fallback.STATE_STORE)
    run(
        spark, tmp_path, [*cut(rows, batches), last],
        lambda stream: fallback.start_fallback(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "station", "ts", ["arrival", "i"], COLUMNS, "3 hours"),
    )
    assert spark.conf.get(fallback.STATE_STORE) == store
    df = spark.createDataFrame(rows, SCHEMA).withColumn("hour", hour_floor("ts"))
    order = F.struct("arrival", "i")
    df = df.withColumn("order", order)
    batch = lookups.source_fallback(df.where("priority = 0").drop("priority"), df.where("priority = 1").drop("priority"), ["station", "hour"], "order", ["i", "value"])
    want = sorted((r.i, r.value, r.priority) for r in batch.collect())
    got = spark.read.parquet(f"{tmp_path}/out").where("station is null or station <> 'tick'")
    assert sorted((r.i, r.value, r.priority) for r in got.collect()) == want


def test_an_open_hour_waits_for_its_primary(spark, tmp_path):
    at = datetime(2024, 1, 1, 5)
    parts = [[(1, "A", at, 1.0, 1, 1)], [(2, "A", at + timedelta(minutes=50), 2.0, 0, 2)], [(3, "A", at + timedelta(hours=2), 3.0, 1, 3)]]
    run(
        spark, tmp_path, parts,
        lambda stream: fallback.start_fallback(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "station", "ts", ["arrival", "i"], COLUMNS, "1 hour"),
    )
    # the primary of the first hour is through, the alternate of the open one is not
    assert [r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]


@pytest.mark.parametrize("batches", [1, 3])
def test_pairs_of_two_streams(spark, tmp_path, batches):
    rows, last = feed(10 + batches)
    named = [r for r in rows if r[1]]

    def start(stream):
        primary, alternate = stream().where("priority = 0"), stream().where("priority = 1")
        return fallback.start_pairs(primary, alternate, f"{tmp_path}/out", f"{tmp_path}/cp", "station", "ts", ["i", "station"], "1 hour", "3 hours")

    run(spark, tmp_path, [*cut(named, batches), last], start)
    hour, want = timedelta(hours=1), []
    for p in (r for r in named if r[4] == 0):
        met = [a[0] for a in named if a[4] == 1 and a[1] == p[1] and abs(a[2] - p[2]) <= hour]
        want += [(p[0], a) for a in met or [None]]
    got = [(r.i, r.alt_i) for r in spark.read.parquet(f"{tmp_path}/out").where("station <> 'tick'").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stations_of_an_hour_share_state_and_timers(spark, tmp_path):
    at, stations = datetime(2024, 1, 1, 5), 400
    first = [(k, f"S{k}", at, None if k % 3 else 1.0, 1, k) for k in range(stations)]
    # every fourth station has a primary reading in the next batch, later ones change nothing
    second = [(1000 + k, f"S{k}", at + timedelta(minutes=9), 2.0, 0, 1000 + k) for k in range(0, stations, 4)]
    third = [(2000 + k, f"S{k}", at + timedelta(minutes=20), 3.0, k % 2, 2000 + k) for k in range(0, stations, 2)]
    last = [(5000 + p, "tick", at + timedelta(days=2), 0.0, p, 10**6) for p in (0, 1)]
    kept = []

    def start(stream):
        job = fallback.start_fallback(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "station", "ts", ["arrival", "i"], COLUMNS, "1 hour")
        job.awaitTermination()
        kept.extend(x["stateOperators"][0]["numRowsTotal"] for x in job.recentProgress if x["stateOperators"])
        return job

    run(spark, tmp_path, [first, second, third, last], start)
    assert 0 < max(kept) <= fallback.BUCKETS + 1
    got = {r.station: (r.i, r.value, r.priority) for r in spark.read.parquet(f"{tmp_path}/out").where("station <> 'tick'").collect()}
    want = {r[1]: (r[0], r[3], r[4]) for r in first} | {r[1]: (r[0], r[3], r[4]) for r in third if r[4] == 0 and (r[0] - 2000) % 4} | {r[1]: (r[0], r[3], r[4]) for r in second}
    assert got == want
