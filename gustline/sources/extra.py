"""Fields outside the canonical record: kept as one VARIANT column and promoted to typed columns when they are wanted."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.schema import CORRUPT, FIELDS
from gustline.sources.observations import ROW_TAG, parse_xml

EXTRA = "extra_fields"


def _unknown(record: Column, known: Iterable[str]) -> Column:
    """The fields of a VARIANT object that are not ``known``, as a VARIANT object; NULL if there are none."""
    names = list(known)
    others = F.map_filter(record.cast("map<string, variant>"), lambda name, _: ~name.isin(names))
    return F.when(F.size(others) > 0, F.to_variant_object(others))


def parse_xml_with_extra(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """:func:`gustline.sources.observations.parse_xml` with the tags outside the 43 fields in the VARIANT column ``extra_fields``.

    Nested tags stay objects and repeated ones arrays. A record without other tags, a broken one and an empty payload have NULL.
    """
    kept = [*keep, xml] if xml not in keep else keep
    rows = parse_xml(df, xml, kept)
    whole = F.when(F.col(CORRUPT).isNull() & (F.length(xml) >= 4), F.from_xml(F.col(xml), "variant", {"rowTag": ROW_TAG, "ignoreNamespace": "true"}))
    rows = rows.withColumn(EXTRA, _unknown(whole, FIELDS))
    return rows if xml in keep else rows.drop(xml)


def csv_with_extra(df: DataFrame, known: Iterable[str] = FIELDS) -> DataFrame:
    """Columns of a file that are not ``known`` packed into ``extra_fields``; the known ones stay, absent ones are not added."""
    names = set(known)
    others = [c for c in df.columns if c not in names]
    if not others:
        return df.withColumn(EXTRA, F.lit(None).cast("variant"))
    entries = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda _, v: v.isNotNull())
    packed = F.when(F.size(entries) > 0, F.to_variant_object(entries))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in names], packed.alias(EXTRA))


def promoted(df: DataFrame, columns: Mapping[str, str], extra: str = EXTRA) -> DataFrame:
    """Add typed columns (name -> type) from ``extra``; a field that is absent or has no value of that type is NULL."""
    return df.withColumns({name: F.try_variant_get(F.col(extra), f"$['{name}']", kind) for name, kind in columns.items()})


def extra_names(df: DataFrame, extra: str = EXTRA) -> DataFrame:
    """``name, n_rows``: which unknown fields there are, and in how many rows; what to promote is decided from it."""
    names = df.select(F.explode(F.map_keys(F.col(extra).cast("map<string, variant>"))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def read_xml_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one record each, as ``file_name, xml``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("xml"))
