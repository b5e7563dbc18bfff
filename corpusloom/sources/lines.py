"""Text lines with their numbers: an offset index of the file splits, then one parse.

A first pass counts the lines of each split; sums of these counts over the splits before it number a line whatever
way the files were split. Identifiers are given below the coalesce, by split and not by task. Both passes plan the same splits, as they read the same files with the same settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Tasks of a pass over lines: more splits than this are read several in a task, each still with an index row of its own.
MOST_TASKS = 512


def place(block: str, within: str, before: str) -> Column:
    """A line's number: the lines of earlier splits, and those before it in its own."""
    return F.col(before) + F.col(within) - F.col(block)


def numbered(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """value, file, line (in its file, from 0), seq (over all files in the order of their names, from 0).

    separator: what ends a line, else any of the usual ends. The index has a row for each split; it is summed in one
    task and broadcast.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).coalesce(MOST_TASKS)
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    index = splits.select("file", "block", "first", earlier(Window.partitionBy("file")).alias("in_file"), earlier(Window.partitionBy(F.lit(0))).alias("in_all"))
    found = rows.join(F.broadcast(index), ["file", "block"])
    return found.select("value", "file", place("first", "id", "in_file").alias("line"), place("first", "id", "in_all").alias("seq"))
