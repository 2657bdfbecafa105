"""Session settings and the shared folder for checkpoints and stream state."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_folder: dict[str, str] = {}
# Folders made by fresh_folder, with the session that made them; removed when Python ends.
_made: list[tuple[SparkSession, str]] = []


def build_session(app_name: str = "gustline", master: str | None = None, **settings: str) -> SparkSession:
    """Session with UTC time and adaptive execution; ``settings`` override any default."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the executors would not
    see it, so the missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_folder:
        _local_folder[context.applicationId] = tempfile.mkdtemp(prefix="gustline-")
    return _local_folder[context.applicationId]


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing path under the shared folder. What is written there is removed when Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it lies; a missing one is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_made() -> None:
    for spark, path in _made:
        # the session may be gone by now
        with contextlib.suppress(Exception):
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                remove_folder(spark, path)


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared folder, so a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
