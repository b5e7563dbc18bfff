"""Connected components of a link table by alternating large and small stars, all as windows over a node's links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import runtime


#: Links (16 bytes each) that one task reduces at once; more are reduced in rounds over all tasks, with the same result.
LOCAL_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links a-b, but for the roots: union-find."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    top = np.fromiter((find(x) for x in range(len(nodes))), np.int64, len(nodes))
    own = top != np.arange(len(nodes))
    return nodes[own], nodes[top[own]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        u, v = forest(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame, reduced: bool = False) -> DataFrame:
    """(node, root) of every node that is not its component's smallest; links: two long columns.

    Links of a task are first reduced to a forest, unless a worker made them as forests (reduced): a task that hands
    them from one worker to the next keeps two alive, and both stay for later tasks. If no more than LOCAL_LINKS are
    left, one task reduces them. Else large stars (every larger neighbour hangs on the smallest known node) and small
    stars (every smaller neighbour does) alternate until the links stay the same, which takes a number of rounds in the
    order of log(n); each round ends in a table in the shared folder.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges, seen = runtime.written(edges if reduced else edges.mapInArrow(_local, "u long, v long"), "links"), (0, None)
    if edges.count() <= LOCAL_LINKS:
        return edges.coalesce(1).mapInArrow(_whole, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = edges.distinct()
    least, of_u = F.min("v").over(Window.partitionBy("u")), F.struct("u", F.col("m").alias("v"))  # one shuffle by u, no join
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", least)).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least).select(F.explode(F.array(of_u, F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, seen = runtime.written(small.where("u <> v").distinct(), "links"), now
