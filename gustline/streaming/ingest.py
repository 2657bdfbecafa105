"""Continuous ingest. Every job resumes from its checkpoint and writes each micro-batch exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gustline.functions.times import wall_micros
from gustline.operators.dedup import highwater_accept
from gustline.operators.ordered import ROWS_PER_SLICE, ordered
from gustline.operators.quality import REQUIRED, is_current, is_suspect, not_before_batch
from gustline.session import remove_folder
from gustline.streaming.state import KeyedState, folders


def table_stream(
    spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int = 10_000, schema=None, recursive: bool = False
) -> DataFrame:
    """Parquet files of a folder as a file stream, with the given schema or that of the files already there. ``recursive`` takes the files of
    its folders too, whatever these are called."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def event_time(df: DataFrame, ts: str, name: str = "event_time") -> DataFrame:
    """Wall clock -> ``timestamp`` for a watermark, independent of the session zone."""
    return df.withColumn(name, F.timestamp_micros(wall_micros(ts)))


def _start(df: DataFrame, checkpoint: str, continuous: str | None):
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace the folder of this batch, so a batch that is run again leaves no repeats."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def clean_records(df: DataFrame, station: str, ts: str, required=REQUIRED, delay: str = "2 hours") -> DataFrame:
    """Flag suspect rows and drop repeated (station, time) records inside the watermark.

    State is one entry per (station, time) of the last ``delay``, spread over all state partitions, so
    a hot station does not land in one task. Spark drops rows behind the watermark; where late rows must not
    be lost, use :func:`start_clean_ingest`, which writes them to a table of their own.
    """
    flagged = event_time(df, ts).withColumn("is_suspect", is_suspect(required))
    return flagged.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([station, "event_time"])


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def start_clean_ingest(
    stream: DataFrame,
    table: str,
    late: str,
    state: str,
    checkpoint: str,
    station: str,
    ts: str,
    arrival: list[str],
    delay_hours: int = 2,
    continuous: str | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> StreamingQuery:
    """Append each (station, time) once, in arrival order; late rows go to the table ``late``. No row is lost.

    A row is late if it is more than ``delay_hours`` older than the newest row of its station that arrived before
    it, in this batch or an earlier one; so the result does not depend on how the feed is cut into batches. The
    state holds the times of the last ``delay_hours`` of each station, which is all that a row that is not late can
    repeat. A NULL station is a station; rows without a time are late.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"_station {kinds[station]}, _ts {kinds[ts]}"
    columns = stream.columns

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            stored = KeyedState(batch.sparkSession, state, schema, "_station")
            keys = stored.read(batch, station, batch_id)
            high = keys.groupBy("_station").agg(F.max("_ts").alias("_stored"))
            scan = ordered(batch, [station], arrival, rows_per_slice).running_max("_run", F.col(ts), inclusive=False).done()
            scan = scan.join(high, _same(F.col(station), F.col("_station")), "left").drop("_station")
            edge = F.greatest("_run", "_stored") - F.make_dt_interval(hours=F.lit(delay_hours))
            is_late = F.col(ts).isNull() | F.coalesce(F.col(ts) < edge, F.lit(False))
            scan = scan.withColumn("_late", is_late).persist()
            _write_batch(scan.where("_late").select(*columns), late, batch_id)
            fresh = scan.where("not _late").groupBy(F.col(station).alias("_s"), F.col(ts).alias("_t")).agg(
                F.min_by(F.struct(*columns), F.struct(*arrival)).alias("_r")
            )
            seen = _same(F.col("_s"), F.col("_station")) & (F.col("_t") == F.col("_ts"))
            _write_batch(fresh.join(keys, seen, "left_anti").select("_r.*"), table, batch_id)
            both = keys.unionByName(fresh.select(F.col("_s").alias("_station"), F.col("_t").alias("_ts"))).distinct()
            newest = both.groupBy(F.col("_station").alias("_s")).agg(F.max("_ts").alias("_high"))
            kept = both.join(newest, _same(F.col("_station"), F.col("_s"))).where(
                F.col("_ts") >= F.col("_high") - F.make_dt_interval(hours=F.lit(delay_hours))
            )
            stored.write(kept.select("_station", "_ts"), batch_id)
            scan.unpersist()
        finally:
            batch.unpersist()

    return _start(stream, checkpoint, continuous).foreachBatch(take).start()


def drop_late(df: DataFrame, obs: str, local_now: Column, batch_date: Column | None = None) -> DataFrame:
    """Keep readings of the local day or hour 23, and not older than the open batch date."""
    kept = df.where(is_current(F.col(obs), local_now))
    return kept.where(not_before_batch(F.col(obs), batch_date)) if batch_date is not None else kept


def late_rows(df: DataFrame, obs: str, local_now: Column, batch_date: Column | None = None) -> DataFrame:
    """The rows :func:`drop_late` drops, for a side table."""
    late = ~is_current(F.col(obs), local_now)
    if batch_date is not None:
        late = late | ~not_before_batch(F.col(obs), batch_date)
    return df.where(late)


def start_ingest(
    records: DataFrame, table: str, checkpoint: str, partition: str = "obs_date", continuous: str | None = None
) -> StreamingQuery:
    """Append to a Parquet table partitioned by day."""
    writer = _start(records, checkpoint, continuous).format("parquet").outputMode("append")
    return writer.partitionBy(partition).start(table)


def start_quarantine(records: DataFrame, folder: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Copy suspect records beside the table."""
    return start_side_table(records.where("is_suspect"), folder, checkpoint, continuous)


def start_side_table(rows: DataFrame, folder: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Append late, broken or suspect rows to a table of their own."""
    return _start(rows, checkpoint, continuous).format("parquet").outputMode("append").start(folder)


def start_highwater(
    stream: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    station: str,
    ts: str,
    arrival: list[str],
    continuous: str | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> StreamingQuery:
    """Accept only readings strictly newer than all earlier ones of the station, across batches.

    Each batch is compared with the stored high-water table, then scanned by the batch operator,
    which splits hot stations; the next high-water table is a partial aggregate. All in the JVM.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"_station {kinds[station]}, _stored {kinds[ts]}"

    def accept(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            table = KeyedState(batch.sparkSession, state, schema, "_station")
            stored = table.read(batch, station, batch_id)
            newer = batch.join(stored, _same(F.col(station), F.col("_station")), "left").drop("_station")
            newer = newer.where(F.col("_stored").isNull() | (F.col(ts) > F.col("_stored")))
            accepted = highwater_accept(newer.drop("_stored"), station, ts, arrival, rows_per_slice=rows_per_slice)
            _write_batch(accepted, out, batch_id)
            seen = stored.unionByName(batch.groupBy(F.col(station).alias("_station")).agg(F.max(ts).alias("_stored")))
            table.write(seen.groupBy("_station").agg(F.max("_stored").alias("_stored")), batch_id)
        finally:
            batch.unpersist()

    return _start(stream, checkpoint, continuous).foreachBatch(accept).start()


def start_content_change(
    stream: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    station: str,
    content: str,
    arrival: list[str],
    continuous: str | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> StreamingQuery:
    """Write every snapshot whose content differs from the station's snapshot before it, in arrival order.

    The first snapshot of a station is a change. Inside a batch an ordered scan finds the one before, the first row of a
    station is compared with the stored fingerprint; so the result does not depend on how the feed is cut into batches. A
    NULL station is a station, and NULL content is content.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"_station {kinds[station]}, _stored string"
    columns = stream.columns

    def changed(batch: DataFrame, batch_id: int) -> None:
        hashed = batch.withColumn("_md5", F.coalesce(F.md5(content), F.lit("null"))).persist()
        try:
            table = KeyedState(batch.sparkSession, state, schema, "_station")
            stored = table.read(hashed, station, batch_id)
            scan = ordered(hashed, [station], arrival, rows_per_slice).previous("_prev", "_md5").done()
            scan = scan.join(stored, _same(F.col(station), F.col("_station")), "left")
            before = F.coalesce(F.col("_prev._md5"), F.col("_stored"))
            _write_batch(scan.where(before.isNull() | (before != F.col("_md5"))).select(*columns), out, batch_id)
            last = hashed.groupBy(F.col(station).alias("_station")).agg(F.max_by("_md5", F.struct(*arrival)).alias("_new"))
            # a station of these buckets that this batch does not name keeps what it has
            both = stored.withColumn("_age", F.lit(0)).unionByName(
                last.select("_station", F.col("_new").alias("_stored"), F.lit(1).alias("_age"))
            )
            table.write(both.groupBy("_station").agg(F.max_by("_stored", "_age").alias("_stored")), batch_id)
        finally:
            hashed.unpersist()

    return _start(stream, checkpoint, continuous).foreachBatch(changed).start()


# Shares of this many batches are added up into one table, so that what a reader lists and reads stays small.
FOLD = 64


def start_tumbling(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    station: str,
    ts: str,
    value: str,
    width: str = "1 day",
    continuous: str | None = None,
    undated: str | None = None,
    fold: int = FOLD,
) -> StreamingQuery:
    """Count and extremes per station and tumbling window.

    Each batch writes its own share of every window it touches, and :func:`read_tumbling` adds the shares up. There is no
    state and no watermark, so a row counts however late it comes. After every ``fold`` batches their shares are added up once; a batch
    that is run again after that changes nothing. Rows without a time belong to no window: they are written to the table ``undated``, or
    counted there under a window that is NULL if no table is named.
    """
    columns = stream.columns

    def share(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if undated:
            _write_batch(batch.where(F.col(ts).isNull()).select(*columns), undated, batch_id)
        timed = batch.where(F.col(ts).isNotNull()) if undated else batch
        # a window function drops rows without a time, so these are given one and lose it again
        known = event_time(timed, ts).withColumn("_when", F.coalesce("event_time", F.timestamp_micros(F.lit(0).cast("bigint"))))
        window = F.when(F.col("event_time").isNotNull(), F.unix_micros(F.window("_when", width)["start"]))
        shares = known.withColumn("window_micros", window).groupBy(station, "window_micros").agg(
            F.count(F.lit(1)).alias("n_rows"), F.max(value).alias("max_value"), F.min(value).alias("min_value")
        )
        _write_batch(shares, out, batch_id)
        if batch_id % fold == fold - 1:
            read_tumbling(spark, out, station, batch_id).write.mode("overwrite").parquet(f"{out}/upto={batch_id}")
            for place in [p for b, p in folders(spark, out, "batch_id=").items() if int(b) < batch_id]:
                remove_folder(spark, place)
            for place in [p for b, p in folders(spark, out, "upto=").items() if int(b) < batch_id]:
                remove_folder(spark, place)

    return _start(stream, checkpoint, continuous).foreachBatch(share).start()


def _finished(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_tumbling(spark: SparkSession, out: str, station: str, last: int | None = None) -> DataFrame:
    """All windows, their shares added up; with ``last`` only those of the batches up to it, as far as they are not folded yet."""
    folded = {int(b): p for b, p in folders(spark, out, "upto=").items() if _finished(spark, p) and (last is None or int(b) < last)}
    newest = max(folded, default=-1)
    paths = [p for b, p in folders(spark, out, "batch_id=").items() if int(b) > newest and (last is None or int(b) <= last)]
    shares = spark.read.parquet(*([folded[newest]] if folded else []), *paths)
    return shares.groupBy(station, "window_micros").agg(
        F.sum("n_rows").alias("n_rows"), F.max("max_value").alias("max_value"), F.min("min_value").alias("min_value")
    )
