"""Tables between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.session import fresh_folder, remove_folder

_PLACE = "_written_place"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    The plan behind it is cut, its rows and ids are fixed, and a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    setattr(table, _PLACE, path)
    return table


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of :func:`written` that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, _PLACE, None)
        if path is not None:
            remove_folder(table.sparkSession, path)


# Ids are broadcast up to this many (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without_ids(df: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is not in the one column of ``ids``. While these are few, nothing of ``df`` is shuffled."""
    ids = written(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(side, F.col(f"`{id_column}`").eqNullSafe(F.col("_id")), "left_anti")
