"""Observation feeds: XML records, station CSV files, and selection of files by name."""

from __future__ import annotations

import re
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.functions.text import NULL_TOKEN
from gustline.functions.times import date_of_file
from gustline.operators.quality import original_files
from gustline.schema import CORRUPT, RAW_RECORD, RAW_WITH_CORRUPT

ROW_TAG = "current_observation"
CSV_RECORD = T.StructType([*RAW_RECORD.fields, T.StructField("collection_time", T.StringType())])


def _xml(reader):
    return (
        reader.format("xml")
        .schema(RAW_WITH_CORRUPT)
        .option("rowTag", ROW_TAG)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreNamespace", "true")
    )


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, fields by name, absent tags NULL; broken records in ``_corrupt_record``."""
    return _xml(spark.read).load(path)


def parse_xml(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Record text in a column -> the 43 fields by name.

    Broken records, and payloads that are NULL or shorter than 4 characters, keep a row without fields whose
    ``_corrupt_record`` is the payload (empty for NULL), so the quarantine can take them.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreNamespace": "true"}
    payload = F.coalesce(F.col(xml), F.lit(""))
    usable = F.length(payload) >= 4
    record = F.from_xml(F.when(usable, payload), RAW_WITH_CORRUPT.simpleString(), options)
    rows = df.select(*keep, record.alias("_r"), F.when(~usable, payload).alias("_payload"))
    fields = [F.col("_r")[f.name].alias(f.name) for f in RAW_WITH_CORRUPT.fields if f.name != CORRUPT]
    return rows.select(*keep, *fields, F.coalesce(F.col("_r")[CORRUPT], "_payload").alias(CORRUPT))


def stream_xml(spark: SparkSession, landing: str, files_per_batch: int = 10_000) -> DataFrame:
    return _xml(spark.readStream).option("maxFilesPerTrigger", files_per_batch).load(landing)


def read_csv(spark: SparkSession, path: str | list[str], glob: str | None = None, multiline: bool = True) -> DataFrame:
    """Station CSV files (quoted, header, no-value token). A missing path gives an empty frame.

    Daily files may hold line breaks inside quotes. Big files without them, such as those written by
    ``sinks.tables``, should be read with ``multiline=False``, so that Spark can split them.
    """
    reader = spark.read.schema(CSV_RECORD).option("header", True).option("nullValue", NULL_TOKEN)
    reader = reader.option("multiLine", multiline).option("escape", '"')
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        return reader.csv(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], CSV_RECORD)


def file_glob(
    station: str, ext: str = "csv", year: int | None = None, month: int | None = None, day: int | None = None
) -> str:
    """Name pattern of a station's files: all, or of a year, month or day."""
    if year is None:
        return f"{station}*.{ext}"
    parts = [f"{station}_Y{year:04d}"]
    if month is not None:
        parts.append(f"_M{month:02d}")
        if day is not None:
            parts.append(f"_D{day:02d}")
    return "".join(parts) + f"_*.{ext}"


def range_glob(station: str, start: date, end: date, ext: str = "csv") -> str:
    """Pattern of the months from ``start`` to ``end``, each once, for listing only those files."""
    months, year, month = [], start.year, start.month
    while (year, month) <= (end.year, end.month):
        months.append(f"Y{year:04d}_M{month:02d}")
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return f"{station}_{{{','.join(months)}}}_D*.{ext}"


def glob_pattern(glob: str) -> str:
    """A name pattern with ``*``, ``?`` and ``{a,b}`` as a regular expression for whole names."""
    signs = {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}
    return "^" + "".join(signs.get(c) or re.escape(c) for c in glob) + "$"


def named_files(spark: SparkSession, folder: str, glob: str, by_folder: bool = False) -> DataFrame:
    """Files with ``file_name``, chosen by name. With ``by_folder`` a file is named by its folder ``record=<name>``, as the sinks write
    them, and only folders of a fitting name are looked into."""
    reader = spark.read.format("binaryFile")
    if by_folder:
        return reader.load(folder).where(F.col("record").rlike(glob_pattern(glob))).withColumnRenamed("record", "file_name")
    name = F.element_at(F.split("path", "/"), -1)
    return reader.option("pathGlobFilter", glob).load(folder).withColumn("file_name", name)


def list_files(spark: SparkSession, folder: str, glob: str, by_folder: bool = False) -> DataFrame:
    """File names with their dates; contents are not read."""
    files = named_files(spark, folder, glob, by_folder)
    return files.select("file_name", "path", "length", "modificationTime").withColumn("file_date", date_of_file("file_name"))


def read_csv_range(spark: SparkSession, folder: str, station: str, start: date, end: date) -> DataFrame:
    """Rows of the daily files dated ``start`` to ``end``, each file once, without combined copies."""
    rows = read_csv(spark, folder, range_glob(station, start, end))
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_name"))
    dated = original_files(rows, "file_name").withColumn("file_date", date_of_file("file_name"))
    return dated.where(F.col("file_date").between(start, end)).drop("file_date")


def read_csv_month(spark: SparkSession, folder: str, station: str, year: int, month: int) -> DataFrame:
    rows = read_csv(spark, folder, file_glob(station, "csv", year, month))
    return original_files(rows.select("*", F.col("_metadata.file_name").alias("file_name")), "file_name")


def read_table_range(spark: SparkSession, path: str, start: date, end: date, station: str | None = None) -> DataFrame:
    """Days ``start`` to ``end`` of the partitioned table; only their partitions are read, and of these, for one station, only row groups
    that can hold it."""
    table = spark.read.parquet(path).where(F.col("obs_date").between(start, end))
    return table.where(F.col("station_id") == station) if station else table
