"""Partitioned observation tables and file exports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.functions.text import NULL_TOKEN, html_escape, html_row
from gustline.functions.times import emit_time, file_key
from gustline.operators.latest import latest_per_key
from gustline.session import reliable_checkpoint

PARTITION = "obs_date"


def _sized_files(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bring a partition's rows together before the write, but let adaptive execution split a big one."""
    return df.hint("rebalance", *keys)


def _dated(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("obs_date", F.to_date(ts))


def append_observations(df: DataFrame, path: str, ts: str = "obs_local") -> None:
    """Append to the table partitioned by day; a new day is simply a new partition.

    A station-day is some 24 rows, far too few for a directory of its own. Files are sorted by station instead and carry a Bloom
    filter on it, so a station filter skips row groups by their statistics and whole files by their filter.
    """
    rows = _sized_files(_dated(df, ts), [PARTITION])
    _table_writer(rows, ts, "append").parquet(path)


def _table_writer(rows: DataFrame, ts: str, mode: str):
    writer = rows.sortWithinPartitions(PARTITION, "station_id", ts).write.mode(mode).partitionBy(PARTITION)
    return writer.option("parquet.bloom.filter.enabled#station_id", "true")


def merge_late(df: DataFrame, path: str, order: list[str], ts: str = "obs_local") -> int:
    """Merge late rows into the table of :func:`append_observations`; the number of days that were written again.

    Of rows with the same station and time the first in ``order`` (columns of the table) stays, whether it came late or not, so the table
    is what ingest of all rows in order would have made. Only days that gain or change a row are read as a whole and replaced; a second
    run finds nothing to do. NULL stations and times are values like any other. Days are replaced one by one: after a crash between two
    of them the same merge completes the rest.
    """
    spark = df.sparkSession
    late = _first_rows(_dated(df, ts), order, ts)
    try:
        table = spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        append_observations(late.drop(PARTITION), path, ts)
        return late.select(PARTITION).distinct().count()
    late = reliable_checkpoint(late.select(*table.columns))
    place = F.struct(*order)
    known = _of_days(table, late).select(F.col("station_id").alias("_station"), F.col(ts).alias("_ts"), place.alias("_place"))
    same = F.col("station_id").eqNullSafe(F.col("_station")) & F.col(ts).eqNullSafe(F.col("_ts"))
    found = late.join(known, same, "left").where(F.col("_place").isNull() | (place < F.col("_place")))
    days = reliable_checkpoint(found.select(PARTITION).distinct())
    touched = days.count()
    if touched:
        # what is replaced has been read and stored before the first day goes
        merged = reliable_checkpoint(_first_rows(_of_days(table, days).unionByName(_of_days(late, days)), order, ts))
        writer = _table_writer(_sized_files(merged.select(*table.columns), [PARTITION]), ts, "overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched


def _first_rows(df: DataFrame, order: list[str], ts: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col("station_id").alias("_s"), F.col(ts).alias("_t")).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def _of_days(table: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the days in ``days``; partitions outside their range are not listed for reading."""
    days = days.select(F.col(PARTITION).alias("_day")).distinct()
    low, high = days.agg(F.min("_day"), F.max("_day")).first()
    undated = F.col(PARTITION).isNull()
    inside = table.where(undated if low is None else F.col(PARTITION).between(low, high) | undated)
    return inside.join(days, F.col(PARTITION).eqNullSafe(F.col("_day")), "left_semi")


def split_days(df: DataFrame, path: str, ts: str = "obs_local", station: str = "*") -> None:
    """Split rows into station/year/month/day partitions, replacing just the ones present."""
    keys = ["station_id", "year", "month", "day"]
    rows = df if station == "*" else df.where(F.col("station_id") == station)
    rows = rows.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})
    writer = _sized_files(rows, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)


def split_manifest(df: DataFrame, station: str, ts: str) -> DataFrame:
    """Partitions a split would write: file name and row count per station and day."""
    counts = df.groupBy(F.col(station).alias("station"), F.to_date(ts).alias("obs_date")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return counts.withColumn("file_name", file_key("station", F.col("obs_date").cast("timestamp_ntz")))


def _csv(df: DataFrame, mode: str):
    writer = df.write.mode(mode).option("header", True).option("quoteAll", True)
    return writer.option("nullValue", NULL_TOKEN).option("escape", '"')


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """Quoted CSV with header and no-value token: ``append`` or ``overwrite``."""
    _csv(df, mode).csv(path)


def guarded_write(df: DataFrame, path: str, force: bool = False) -> None:
    """Keep existing output unless ``force``."""
    write_csv(df, path, "overwrite" if force else "ignore")


def combine(df: DataFrame, path: str, order: list[str], force: bool = False) -> None:
    """Range, month or year output, globally sorted over as many files as the volume needs."""
    guarded_write(df.orderBy(*order), path, force)


def write_quarantine(flagged: DataFrame, path: str) -> None:
    flagged.where("is_suspect").write.mode("append").parquet(path)


def write_latest(df: DataFrame, path: str, keys: list[str], order: list[str], columns: list[str]) -> None:
    """Replace the snapshot with the newest row per key."""
    latest_per_key(df, keys, order, columns).write.mode("overwrite").parquet(path)


def write_xml(df: DataFrame, path: str, last_row_by: list[str] | None = None) -> None:
    """Records as XML, NULL fields left out; with ``last_row_by`` only the newest record per station."""
    if last_row_by:
        others = [c for c in df.columns if c != "station_id"]
        df = latest_per_key(df, ["station_id"], last_row_by, others)
    writer = df.write.mode("overwrite").format("xml").option("rootTag", "observations")
    writer.option("rowTag", "current_observation").save(path)


def xml_record(*columns: str):
    """One record as XML text without its NULL fields."""
    tags = [F.concat(F.lit(f"<{c}>"), html_escape(c), F.lit(f"</{c}>")) for c in columns]
    return F.concat(F.lit("<current_observation>"), F.concat_ws("", *tags), F.lit("</current_observation>"))


def update_text(ts: str, zone: str) -> Column:
    """Local time in the words of the feed: ``Last Updated on Jan 5 2021, 8:52 am EST``."""
    clock = F.concat(F.date_format(ts, "MMM d yyyy, h:mm "), F.lower(F.date_format(ts, "a")))
    return F.concat(F.lit("Last Updated on "), F.concat_ws(" ", clock, F.col(zone)))


def write_xml_files(df: DataFrame, path: str, columns: list[str], station: str = "station_id", ts: str = "obs_local") -> None:
    """One file per record, in a folder named after station and time like ``KDCA_Y2021_M01_D05_H08``.

    For feeds of single records, not for histories: a file holds one record.
    """
    name = F.regexp_replace(file_key(station, ts), r"\.csv$", "")
    rows = df.select(name.alias("record"), xml_record(*columns).alias("value"))
    rows.repartition("record").write.mode("overwrite").partitionBy("record").text(path)


def write_named_files(df: DataFrame, path: str, name: str, body: str) -> None:
    """One text file per row, in a folder ``record=<name>``, which readers take for the file's name."""
    rows = df.select(F.col(name).alias("record"), F.col(body).alias("value"))
    rows.repartition("record").write.mode("overwrite").partitionBy("record").text(path)


def write_sections(sections: DataFrame, path: str, doc: str, pos: str, line: str) -> None:
    """Section lines as CSV files, sorted by document, section and position over as many files as the volume needs.

    A section of any length stays in order from one file to the next; nothing is joined in memory.
    """
    rows = sections.select(doc, "section_pos", "section", pos, line)
    _csv(rows.orderBy(doc, "section_pos", pos), "overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_cell(df: DataFrame, column: str):
    """A value as JSON: numbers and booleans bare, NULL and non-finite numbers as null, all else as text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType | T.BooleanType):
        text = F.col(column).cast("string")
        finite = ~text.isin("NaN", "Infinity", "-Infinity") if isinstance(kind, T.FractionalType) else F.lit(True)
        return F.when(F.col(column).isNotNull() & finite, text).otherwise("null")
    # an array of one text, without its brackets
    quoted = F.to_json(F.array(F.col(column).cast("string")))
    return F.when(F.col(column).isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise("null")


def _json_list(items):
    return F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]"))


def split_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in "split" orientation, for tables of any length: ``data`` is a row's JSON array, next to the shared ``columns``."""
    names = json.dumps(columns, separators=(",", ":"), ensure_ascii=False)
    return df.withColumns({"columns": F.lit(names), "data": _json_list(F.array(*[json_cell(df, c) for c in columns]))})


def split_json_objects(df: DataFrame, keys: list[str], index: str, columns: list[str]) -> DataFrame:
    """One object ``{"columns", "index", "data"}`` per key, rows in the order of ``index``.

    For keys of bounded size, such as a station-day of hourly rows.
    """
    rows = split_json(df, columns)
    entry = F.struct(F.col(index).alias("i"), json_cell(df, index).alias("t"), F.col("data").alias("d"))
    found = rows.groupBy(*keys, "columns").agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    parts = [
        F.lit('{"columns":'), F.col("columns"), F.lit(',"index":'), _json_list(F.transform("_rows", lambda r: r["t"])),
        F.lit(',"data":'), _json_list(F.transform("_rows", lambda r: r["d"])), F.lit("}"),
    ]
    return found.select(*keys, F.concat(*parts).alias("json"))


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One ``<tr>`` per row; the table can be of any length because rows are never brought together."""
    return df.withColumn("html", html_row(*columns))


def write_html(df: DataFrame, path: str, keys: list[str], order: list[str], columns: list[str]) -> None:
    """HTML table rows as text files per key (station, day), sorted inside each file."""
    rows = html_rows(df, columns).select(*keys, *[c for c in order if c not in keys], F.col("html").alias("value"))
    sorted_rows = _sized_files(rows, keys).sortWithinPartitions(*keys, *order).select(*keys, "value")
    sorted_rows.write.mode("overwrite").partitionBy(*keys).text(path)


def html_fragments(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One table fragment per key, for keys of bounded size such as a station-day of hourly rows."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), html_row(*columns).alias("h"))))
    return df.groupBy(*keys).agg(
        F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r: r["h"]), ""), F.lit("</table>")).alias("html")
    )
