"""Session-level helpers: shared folder, reliable checkpoints, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_FILES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Where the stages in use were written.
_places: WeakKeyDictionary = WeakKeyDictionary()


def read_table(spark: SparkSession, location: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{location}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="kohorta-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/kohorta-scratch/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a written stage after its last reader."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    with passing_shuffles(df.sparkSession):
        df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[rows] = path
    return rows


def drop_stages(*stages: DataFrame) -> None:
    """Remove what ``stage`` wrote, after its last reader."""
    for rows in stages:
        drop_scratch(rows.sparkSession, _places.pop(rows))


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the copy survives the loss of executors."""
    shared_folder(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "4m"):
    """What runs meanwhile hands its rows to Python in batches of about that many bytes, where the session would count rows only:
    a batch lies in memory on both sides, and 10,000 documents are many."""
    return _setting(spark, BATCH_BYTES_KEY, size)


def passing_shuffles(spark: SparkSession):
    """Shuffle files of a plan that is made and run meanwhile go when it has run: what it wrote is read instead. Without this they stay
    until the driver happens to collect its garbage, which on large tables can be after all other stages."""
    return _setting(spark, SHUFFLE_FILES_KEY, "true")


def holds_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting; larger sides stay with the shuffle join."""
    return F.broadcast(df) if holds_at_most(df, max_rows) else df
