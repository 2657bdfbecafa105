"""State tables of streaming jobs: one small table per bucket of keys, so a micro-batch reads and writes only the buckets it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.session import remove_folder

BUCKETS = 64


def bucket_of(key: Column) -> Column:
    """The bucket of a key; NULL is a key like any other."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def folders(spark: SparkSession, path: str, prefix: str) -> dict[str, str]:
    """Sub-folders ``<prefix><name>`` of a folder on whatever store it lies, by name; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return {}
    found = (entry.getPath() for entry in store.listStatus(place) if entry.isDirectory())
    return {p.getName()[len(prefix) :]: p.toString() for p in found if p.getName().startswith(prefix)}


class KeyedState:
    """Versions of a state table under ``path/bucket=<b>/version=<batch>``.

    A batch sees, per bucket, the newest version of an earlier batch, and writes a version of its own for the buckets it names; so a batch
    that is run again finds what it found before. The version before stays for such a rerun, older ones of these buckets go. What is listed
    is bounded by the number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _versions(self, bucket: int) -> dict[int, str]:
        return {int(v): p for v, p in folders(self.spark, f"{self.path}/bucket={bucket}", "version=").items()}

    def read(self, batch: DataFrame, key: str, batch_id: int) -> DataFrame:
        """The state of all buckets that keys of ``batch`` fall into."""
        self.buckets = sorted(r[0] for r in batch.select(bucket_of(F.col(key))).distinct().collect())
        kept = [{v: p for v, p in self._versions(b).items() if v < batch_id} for b in self.buckets]
        paths = [versions[max(versions)] for versions in kept if versions]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, state: DataFrame, batch_id: int) -> None:
        """Replace the state of the buckets that were read. A bucket never gets empty, because what is kept of a key never does."""
        rows = state.withColumns({"bucket": bucket_of(F.col(self.key)), "version": F.lit(batch_id)})
        writer = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "version").parquet(self.path)
        for b in self.buckets:
            versions = self._versions(b)
            for old in sorted(v for v in versions if v < batch_id)[:-1]:
                remove_folder(self.spark, versions[old])
