"""Appends that can be played again: tables keyed by batch, visible once the batch's marker is written.

A batch's rows lie in a folder of their own in each table (batch=<id>), which a repeated attempt replaces; the marker
in the log comes last, so a batch is in all tables or in none, however often it was tried. Readers take the batches
that have a marker. Files are listed through Hadoop's file systems, so any store that Spark writes to will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom import runtime


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _marker(log: str, batch: str) -> str:
    return f"{log}/commits/batch={batch}"


def is_committed(spark: SparkSession, log: str, batch: str) -> bool:
    return exists(spark, f"{_marker(log, batch)}/_SUCCESS")


def committed(spark: SparkSession, log: str) -> DataFrame:
    """batch: the ids of the batches that have a marker."""
    if not exists(spark, f"{log}/commits"):
        return spark.createDataFrame([], "batch string")
    return spark.read.schema("batch string").json(f"{log}/commits/batch=*").distinct()


def staged(spark: SparkSession, log: str, batch: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make(), made once for a batch: an attempt that finds them whole does not make them again."""
    path = f"{log}/staged/batch={batch}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append(spark: SparkSession, log: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """Write a batch's rows to its folder in each table (by path), then its marker; nothing if the marker is there."""
    if is_committed(spark, log, batch):
        return
    for path, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").json(_marker(log, batch))


def read(spark: SparkSession, log: str, path: str, schema: str) -> DataFrame:
    """The rows of a table's committed batches; no rows where there is no table yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, batch string").json(path)
    return found.join(runtime.sized(committed(spark, log)), "batch", "left_semi").drop("batch")
