"""Writers and restartable stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kohorta.session import passing_shuffles


def sink_csv(df: DataFrame, path: str, encoding: str = "UTF-8", sep: str = ",") -> None:
    df.write.mode("errorifexists").option("header", True).option("encoding", encoding).option(
        "sep", sep).csv(path)


def sink_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reload a stage that was written completely before, else compute and write it."""
    if not _complete(spark, path):
        rows = build()
        with passing_shuffles(spark):
            rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
