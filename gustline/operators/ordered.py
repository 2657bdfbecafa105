"""Ordered scans (previous row, next row, running value) that survive a hot key.

A plain window over ``partitionBy(station)`` puts every row of one station into one task. Here only
the keys that are too big for that are treated apart:

1. one narrow, map-side-combined count finds the keys above ``rows_per_slice`` rows, unless the caller knows them;
2. rows of those keys are range-partitioned on (key, order), so each partition is one contiguous,
   evenly sized *slice* of the order, and checkpointed, which fixes the slice numbers;
3. window functions run per (key, slice); what a slice needs from its neighbours is carried over by a
   table with one row per (key, slice).

All other keys go through the ordinary window. Results are the same for any slice size.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.session import reliable_checkpoint

SLICE = "_slice"
ROWS_PER_SLICE = 4_000_000
# Session setting that replaces the default above, for executors with more or less memory.
ROWS_PER_SLICE_SETTING = "spark.gustline.rowsPerSlice"


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right["_r_" + k]) for k in keys])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: "_r_" + k for k in keys})


def _join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with the hot-key list or a carry table (one narrow row per hot key and slice). Both are usually a few rows, but
    nothing bounds them, so Spark's own size check decides whether they are broadcast."""
    right = _renamed(right, keys)
    return left.join(right, _same(left, right, keys), how).drop(*["_r_" + k for k in keys])


@dataclass(frozen=True)
class Ordered:
    """A DataFrame with a total order inside each key; made by :func:`ordered`."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    slices: int = 0

    def _window(self):
        keys = [*self.keys, SLICE] if self.slices else self.keys
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _per_slice(self, value: Column) -> DataFrame:
        return self.df.where(F.col(SLICE) >= 0).groupBy(*self.keys, SLICE).agg(value.alias("_v"))

    def _with_carry(self, df: DataFrame, per_slice: DataFrame, carried: Column) -> DataFrame:
        carry = per_slice.select(*self.keys, SLICE, carried.alias("_carry")).where(F.col("_carry").isNotNull())
        return _join_small(df, carry, [*self.keys, SLICE], "left")

    def _neighbour(self, out: str, cols: list[str], forward: bool) -> Ordered:
        shift, edge = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
        row = F.struct(*cols)
        df = self.df.withColumn(out, shift(row).over(self._window()))
        if self.slices:
            ends = self._per_slice(edge(row, F.struct(*self.order)))
            carried = shift("_v").over(Window.partitionBy(*self.keys).orderBy(SLICE))
            df = self._with_carry(df, ends, carried)
            df = df.withColumn(out, F.coalesce(out, "_carry")).drop("_carry")
        return replace(self, df=df)

    def previous(self, out: str, *cols: str) -> Ordered:
        """Add ``out``: struct of ``cols`` of the row before, NULL for the first row of a key."""
        return self._neighbour(out, list(cols), forward=False)

    def following(self, out: str, *cols: str) -> Ordered:
        """Add ``out``: struct of ``cols`` of the row after, NULL for the last row of a key."""
        return self._neighbour(out, list(cols), forward=True)

    def running_max(self, out: str, value: Column, inclusive: bool = True) -> Ordered:
        """Add ``out``: largest non-null ``value`` up to this row (or up to the row before)."""
        last = 0 if inclusive else -1
        df = self.df.withColumn(out, F.max(value).over(self._window().rowsBetween(Window.unboundedPreceding, last)))
        if self.slices:
            before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
            df = self._with_carry(df, self._per_slice(F.max(value)), F.max("_v").over(before))
            df = df.withColumn(out, F.greatest(out, "_carry")).drop("_carry")
        return replace(self, df=df)

    def running_sum(self, out: str, value: Column) -> Ordered:
        """Add ``out``: sum of the integer ``value`` up to and including this row."""
        value = F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
        df = self.df.withColumn(out, F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0)))
        if self.slices:
            before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
            df = self._with_carry(df, self._per_slice(F.sum(value)), F.sum("_v").over(before))
            df = df.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_carry")
        return replace(self, df=df)

    def mark(self, **columns: Column) -> Ordered:
        """Add row-wise columns without leaving the ordered scan."""
        return replace(self, df=self.df.withColumns(columns))

    def done(self) -> DataFrame:
        return self.df.drop(SLICE)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rows_per_slice: int | None = ROWS_PER_SLICE,
    hot_keys: DataFrame | None = None,
) -> Ordered:
    """Start an ordered scan. ``order`` must be total inside a key: end it with a unique column.

    ``rows_per_slice=None`` skips the search for hot keys; only for input whose rows per key are bounded,
    such as one row per station and hour. A caller that knows the hot keys passes them as ``hot_keys``, a
    table of the key columns and their number of rows ``n`` (as a stored profile has it); no job runs then
    before the scan itself, and keys that are not in it count as small.

    Without them the input is read twice: for the count, and, if a key is hot, for a reliable checkpoint
    that all further steps read.
    """
    keys, order = list(keys), list(order)
    if rows_per_slice is None:
        return Ordered(df, keys, order)
    if rows_per_slice == ROWS_PER_SLICE:
        rows_per_slice = int(df.sparkSession.conf.get(ROWS_PER_SLICE_SETTING, str(ROWS_PER_SLICE)))
    if hot_keys is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_slice)
        hot_keys = reliable_checkpoint(counts)
        total = hot_keys.agg(F.sum("n")).first()[0]
        if total is None:
            return Ordered(df, keys, order)
        df = reliable_checkpoint(df)
    else:
        total = hot_keys.agg(F.sum("n")).first()[0] or 1
    hot_keys = hot_keys.select(*keys)
    sliced = reliable_checkpoint(
        _join_small(df, hot_keys, keys, "left_semi")
        .repartitionByRange(ceil(total / rows_per_slice), *keys, *order)
        .withColumn(SLICE, F.spark_partition_id())
    )
    rest = _join_small(df, hot_keys, keys, "left_anti").withColumn(SLICE, F.lit(-1))
    return Ordered(sliced.unionByName(rest), keys, order, ceil(total / rows_per_slice))
