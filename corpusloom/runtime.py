"""Shared-folder scratch tables and small session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, one of our own where it is unset.

    Raises on a cluster without that setting: a machine-local folder would not be seen by other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet below the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **numbers: Column) -> tuple[DataFrame, dict[str, int]]:
    """written(df, name), and aggregates of its rows that were taken while they were written."""
    seen = Observation(name)
    out = written(df.observe(seen, *(c.alias(n) for n, c in numbers.items())), name)
    return out, seen.get


def ordered(df: DataFrame, order: list[str], number: str, name: str) -> DataFrame:
    """df in this order with the number of each row from 0 (int), by range partitions and no task that holds all rows.

    The rows are written once; the number of rows in each partition, a row for each, is summed and broadcast.
    """
    part, at = unused(df.columns, "part"), unused(df.columns, "at")
    placed = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = written(placed.withColumn(part, F.shiftright(at, 33)), name)
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = placed.join(F.broadcast(sizes.select(part, before.alias(number))), part)
    return found.withColumn(number, (F.col(number) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop(part, at)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows of a few ids or hashes (about 40 MB); df must be cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


#: Keys that may be broadcast as heavy: each holds more than one part in so many of the rows, so there are no more of them.
MOST_HEAVY = 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """left joined with right (how: inner or left), without a task that holds a heavy key.

    right has one row for each key, with the number n of left's rows that have it, and is a written table, as left
    should be: both are read twice. Keys with more than one in MOST_HEAVY of these rows are broadcast, all others are
    joined by a shuffle, of which a key then is a small part. n is not in the result.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    heavy, light = F.col(n) > total / MOST_HEAVY, right.where(F.col(n) <= total / MOST_HEAVY).drop(n)
    named = F.broadcast(right.where(heavy).drop(n))
    if not right.where(heavy).limit(1).count():
        return left.join(light, keys, how)
    return left.join(named, keys).unionByName(left.join(named.select(*keys), keys, "left_anti").join(light, keys, how))


def local_path(uri: str) -> str:
    """The mounted path of a file: URI or plain path; raises for stores that cannot be mapped into memory."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise RuntimeError(f"{uri} is not a mounted folder; files there cannot be memory-mapped")
    return uri


def unused(columns: list[str], name: str) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
