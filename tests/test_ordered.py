import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gustline.operators import audit, dedup, sections
from gustline.operators.ordered import ordered


@pytest.fixture(scope="module")
def feed(spark):
    """One station with a third of all rows, one without a name, and 40 small ones; many equal times."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        station = "hot" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"s{rng.randrange(40)}"
        value = rng.randrange(6) if rng.random() > 0.1 else None
        rows.append((station, rng.randrange(200), i, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "station string, t int, id int, v int").repartition(7)


def same(a, b):
    key = lambda r: tuple((x is not None, x if not isinstance(x, dict) else sorted(x.items())) for x in r)
    rows = lambda d: sorted([tuple(r) for r in d.select(*sorted(d.columns)).collect()], key=key)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("size", [9, 100, 10_000])
def test_slices_give_the_plain_windows(feed, size):
    start = lambda: ordered(feed, ["station"], ["t", "id"], size)
    assert (start().slices > 0) == (size < 1000)
    got = (
        start()
        .previous("p", "v")
        .following("n", "v", "t")
        .running_max("m", F.col("v"))
        .running_max("mx", F.struct("v", "t"), inclusive=False)
        .running_sum("s", F.col("v"))
        .done()
    )
    w = Window.partitionBy("station").orderBy("t", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = feed.select(
        "*",
        F.lag(F.struct("v")).over(w).alias("p"),
        F.lead(F.struct("v", "t")).over(w).alias("n"),
        F.max("v").over(upto).alias("m"),
        F.max(F.struct("v", "t")).over(before).alias("mx"),
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"),
    )
    same(got, want)


def test_many_hot_keys_and_given_hot_keys(feed):
    """No limit on hot keys or slices; with given hot keys the scan gives the same rows."""
    plain = lambda o: o.previous("p", "v").done()
    want = plain(ordered(feed, ["station"], ["t", "id"]))
    same(plain(ordered(feed, ["station"], ["t", "id"], 2)), want)
    given = feed.groupBy("station").agg(F.count("*").alias("n")).where("n > 300")
    scan = ordered(feed, ["station"], ["t", "id"], 100, hot_keys=given)
    assert scan.slices > 1
    same(plain(scan), want)


def test_one_key_with_nine_tenths_of_the_rows(spark):
    df = spark.range(3000).select(F.expr("if(id % 10 = 0, 'cold', 'hot')").alias("k"), (F.col("id") * 17 % 101).alias("t"), "id")
    scan = ordered(df, ["k"], ["t", "id"], 200).previous("p", "id").done()
    w = Window.partitionBy("k").orderBy("t", "id")
    same(scan, df.withColumn("p", F.lag(F.struct("id")).over(w)))


def test_hot_path_reads_the_input_twice(spark, tmp_path):
    """Once for the count, once for the checkpoint: the scan's own plan does not read the files again."""
    spark.range(2000).select(F.lit("hot").alias("k"), "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scan = ordered(df, ["k"], ["id"], 100).previous("p", "id").done()
    assert "FileScan" not in scan._jdf.queryExecution().executedPlan().toString()


def test_hot_slices_are_even(feed):
    hot = ordered(feed, ["station"], ["t", "id"], 100).df.where("_slice >= 0")
    sizes = [r["count"] for r in hot.groupBy("station", "_slice").count().collect()]
    assert max(sizes) <= 300 and sum(sizes) >= 500


@pytest.mark.parametrize("size", [25, 10_000])
def test_operators_do_not_depend_on_the_slice_size(feed, size):
    rows = feed.withColumn("ts", F.timestamp_add("HOUR", F.col("t"), F.lit("2024-01-01").cast("timestamp_ntz")))
    order = ["t", "id"]
    same(
        dedup.highwater_accept(rows, "station", "ts", ["id"], rows_per_slice=size),
        dedup.highwater_accept(rows, "station", "ts", ["id"]),
    )
    same(dedup.change_only(rows, "station", "v", order, size), dedup.change_only(rows, "station", "v", order))
    same(
        dedup.consecutive_duplicates(rows, "station", "v", order, size),
        dedup.consecutive_duplicates(rows, "station", "v", order),
    )
    same(audit.gap_rows(rows, "station", "ts", ["id"], size), audit.gap_rows(rows, "station", "ts", ["id"]))
    same(audit.backwards_rows(rows, "station", "ts", ["id"], size), audit.backwards_rows(rows, "station", "ts", ["id"]))
    same(audit.plateau_flag(rows, "station", "v", order, size), audit.plateau_flag(rows, "station", "v", order))
    same(
        audit.rollover_segments(rows, "station", "ts", order, 6, size),
        audit.rollover_segments(rows, "station", "ts", order, 6),
    )
    same(
        audit.retime_repair(rows, "station", "ts", "id", ["v"], size), audit.retime_repair(rows, "station", "ts", "id", ["v"])
    )
    header = F.when(F.col("v") == 3, F.lit("H"))
    same(
        sections.section_lines(rows, "station", "id", header, size), sections.section_lines(rows, "station", "id", header)
    )
