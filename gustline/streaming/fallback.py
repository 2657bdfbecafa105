"""Primary and alternate source while both streams run: absence timers, and pairs of both sources.

Time here is event time. A row must come within ``delay`` of the newest row of its stream; results are then the same however the feed is
cut into batches. Rows that come later than that are dropped by Spark's watermark; where they must be kept, split them off before with
:func:`gustline.streaming.ingest.late_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gustline.functions.times import hour_floor, wall_micros
from gustline.streaming.ingest import event_time

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PRIORITY, HOUR_MS = "priority", 3_600_000
# Names that Python sees beside those of the columns.
STATION, PRIMARY = "of_station", "is_primary"
# Groups that the stations of an hour are spread over.
BUCKETS = 16


class AbsenceTimer(StatefulProcessor):
    """State of one hour and one bucket of stations: the stations whose primary reading was let through, and the first alternate reading
    of each of the others.

    A primary reading is let through when it comes. The first row of an hour sets a timer for the hour's end; when it fires, the alternate
    readings of stations without a primary one are let through. The state goes with the timer. Rows are handled a frame at a time, so the
    cost of a call and of its state is shared by the stations of a bucket.
    """

    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hour", "through binary, waiting binary")

    def _first(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The first row of each station."""
        for column in reversed(self.order):
            rows = rows.sort_values(column, kind="stable")
        return rows.drop_duplicates(STATION)

    def _first_of_both(self, parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
        """The first primary and the first alternate row of each station."""
        return [parts[i] if len(parts) == 2 else self._first(pd.concat(parts[i::2])) for i in (0, 1)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = []
        for part in rows:
            # NULL is no 0, so it is an alternate source
            is_primary = part[PRIORITY] == 0
            parts += [self._first(part[is_primary]), self._first(part[~is_primary])]
        primary, alternate = self._first_of_both(parts)
        # an alternate reading without any value is none
        alternate = alternate[alternate[self.columns].notna().any(axis=1)]
        through, known = primary[STATION], self.state.get()
        if known is None:
            self.handle.registerTimer(int(key[0]) + HOUR_MS)
        else:
            before, waiting = _frame(known[0])[STATION], _frame(known[1])
            primary = primary[~through.isin(before)]
            through = pd.concat([before, primary[STATION]])
            alternate = alternate[~alternate[STATION].isin(waiting[STATION])][[STATION, *self.columns]]
            alternate = pd.concat([x for x in (waiting, alternate) if len(x)] or [alternate])
        # what was let through needs no row kept beside it
        waiting = alternate[~alternate[STATION].isin(through)]
        self.state.update((_packed(through.to_frame()), _packed(waiting[[STATION, *self.columns]])))
        if len(primary):
            yield primary[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = _frame(self.state.get()[1])
        self.state.clear()
        if len(waiting):
            yield waiting[self.columns]

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(rows[c], from_pandas=True) for c in rows], names=list(rows))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _frame(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas()


def fallback_stream(
    stream: DataFrame, station: str, ts: str, arrival: list[str], columns: list[str], delay: str, buckets: int = BUCKETS
) -> DataFrame:
    """Per station and hour the first primary reading, or the first alternate one if no primary came by the hour's end and ``delay``.

    ``stream`` holds both sources, told apart by the column ``priority`` (0: primary). The result has the given columns. It equals the
    batch rule (:func:`gustline.operators.lookups.source_fallback`) for all hours that the watermark has passed. The key is the hour and
    one of ``buckets`` of stations, so an hour is spread over that many groups of which each holds one row per station; the number must
    not change between runs on one checkpoint. State is kept for open hours only. Rows without a time are left out; a NULL station is one.
    """
    rows = event_time(stream.where(F.col(ts).isNotNull()), ts).withWatermark("event_time", delay)
    # Python sees columns by place: any name is fine then
    named = {c: f"column_{i}" for i, c in enumerate(dict.fromkeys([*columns, *arrival]))}
    # never NULL, so that a NULL station is like any other
    of_station = F.coalesce(F.concat(F.lit("="), F.col(station).cast("string")), F.lit(""))
    rows = rows.select(
        (wall_micros(hour_floor(ts)) / 1000).cast("bigint").alias("hour_ms"),
        F.pmod(F.xxhash64(of_station), F.lit(buckets)).alias("bucket"),
        of_station.alias(STATION), F.col(PRIORITY).alias(PRIORITY), *[F.col(c).alias(name) for c, name in named.items()], "event_time",
    )
    fields = [T.StructField(named[c], stream.schema[c].dataType, True) for c in columns]
    timer = AbsenceTimer([named[c] for c in columns], [named[c] for c in arrival])
    found = rows.groupBy("hour_ms", "bucket").transformWithStateInPandas(
        timer, outputStructType=T.StructType(fields), outputMode="Append", timeMode="EventTime"
    )
    return found.toDF(*columns)


def start_fallback(
    stream: DataFrame, out: str, checkpoint: str, station: str, ts: str, arrival: list[str], columns: list[str], delay: str = "2 hours",
    continuous: str | None = None,
) -> StreamingQuery:
    """Append the readings of :func:`fallback_stream` to ``out``. Timers need the RocksDB state store, which this query alone is given."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        rows = fallback_stream(stream, station, ts, arrival, columns, delay)
        return _append(rows, out, checkpoint, continuous)
    finally:
        # a running query keeps the settings it was started with
        spark.conf.set(STATE_STORE, before)


def _append(rows: DataFrame, out: str, checkpoint: str, continuous: str | None) -> StreamingQuery:
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    return writer.format("parquet").outputMode("append").start(out)


def paired_stream(
    primary: DataFrame, alternate: DataFrame, station: str, ts: str, columns: list[str], within: str = "1 hour", delay: str = "2 hours"
) -> DataFrame:
    """Each primary reading with every alternate one of its station at most ``within`` before or after it; alone if there is none.

    A join of two streams with a watermark on either side: state holds what can still meet a row, and a primary reading without a partner
    comes out when the watermark has passed the time in which one could come. ``columns`` are taken from both sides, those of the alternate
    with the prefix ``alt_``. Rows without a time have no partner and are left out.
    """
    left = event_time(primary.where(F.col(ts).isNotNull()), ts).withWatermark("event_time", delay)
    right = event_time(alternate.where(F.col(ts).isNotNull()), ts, "alt_event_time").withWatermark("alt_event_time", delay)
    right = right.select("alt_event_time", F.col(station).alias("_station"), *[F.col(c).alias(f"alt_{c}") for c in columns])
    near = F.expr(f"alt_event_time >= event_time - INTERVAL {within} AND alt_event_time <= event_time + INTERVAL {within}")
    met = left.join(right, (F.col(station) == F.col("_station")) & near, "leftOuter")
    return met.select(*columns, *[f"alt_{c}" for c in columns])


def start_pairs(
    primary: DataFrame, alternate: DataFrame, out: str, checkpoint: str, station: str, ts: str, columns: list[str],
    within: str = "1 hour", delay: str = "2 hours", continuous: str | None = None,
) -> StreamingQuery:
    """Append the pairs of :func:`paired_stream` to ``out``."""
    return _append(paired_stream(primary, alternate, station, ts, columns, within, delay), out, checkpoint, continuous)
