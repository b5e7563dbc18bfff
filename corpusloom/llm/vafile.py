"""Hard-negative mining with a vector-approximation file.

Vectors become integers floor(scale * x); a score is an integer inner product. Rows are dealt into shards by a hash; in
a shard each dimension is cut into cells at its quantiles, and a vector is kept as one cell number a dimension. For an
anchor, a table per dimension gives the least and the greatest product with each cell, so summed lookups bound a row's
score from both sides. Only rows that may enter a result are scored exactly:

* positives: rows of the anchor's label whose upper bound reaches the k-th greatest lower bound among them;
* negatives: for each positive, rows of another label whose bounds meet its window of scores and reach the k-th
  greatest lower bound among the rows that lie in the window for certain.

A shard's rows come into a task once, followed by all anchors (the stated query set against all rows), which pass
through a batch at a time; only anchors are copied, once for each shard. Each shard returns at most k rows for an
anchor or window, and windows over these give the whole result, ties to the smaller id.

Defined cases: rows with a null id or label, a null or empty vector, or a null or non-finite component take no part;
equal rows count once; of anchors that share an id, the one with the smallest vector is used, and rows of that id are
never its partners; vectors of another length than the anchor's are no partners; windows of negative positives are
empty; an empty table gives no row. Scores must stay below 2**62.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import runtime

#: Most rows expected in a shard, least rows for which another shard is opened, cells of a dimension, anchors and rows bounded at a time.
SHARD_ROWS, LEAST_ROWS, CELLS, BLOCK, STRIP = 32_768, 1024, 64, 64, 1024


class VAFile:
    """The cell numbers of a shard's vectors, and bounds of inner products by lookup."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, cells: int = CELLS):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.codes, self.low, self.high = [], [], []
        for x in vectors.T:
            ordered = np.sort(x)
            starts = np.unique(ordered[np.arange(cells) * len(x) // cells])
            first = np.searchsorted(ordered, starts)
            self.codes.append((np.searchsorted(starts, x, "right") - 1).astype(np.uint8 if cells <= 256 else np.int64))
            self.low.append(starts.astype(np.float64))
            self.high.append(ordered[np.append(first[1:], len(x)) - 1].astype(np.float64))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each row's score (rows x queries), rounding allowed for."""
        real = q.astype(np.float64)
        least, greatest = np.zeros((len(self.ids), len(q))), np.zeros((len(self.ids), len(q)))
        tables = []
        for d in range(q.shape[1]):
            a, b = self.low[d][:, None] * real[:, d], self.high[d][:, None] * real[:, d]
            tables.append((np.minimum(a, b), np.maximum(a, b)))
        for at in range(0, len(self.ids), STRIP):
            rows = slice(at, at + STRIP)
            for code, (low, high) in zip(self.codes, tables):
                own = code[rows].astype(np.intp)
                least[rows] += low.take(own, 0)
                greatest[rows] += high.take(own, 0)
        slack = np.abs(real).sum(1) * self.most * 1e-12 + 0.5
        return least - slack, greatest + slack

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer scores of some rows with one query."""
        if self.most * float(np.abs(q.astype(np.float64)).sum()) < 2**53:
            return (self.vectors[rows].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ q

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first k: higher scores, then smaller ids."""
        order = np.lexsort((self.ids[rows], ~scores))[:k]
        return self.ids[rows][order], scores[order]

    def positives(self, i: int, label: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero((self.labels == label) & (self.ids != i))
        if len(rows) > k:
            rows = rows[high[rows] >= np.partition(low[rows], -k)[-k]]
        return self.best(rows, self.exact(rows, q), k)

    def negatives(self, i: int, label: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, windows: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, greatest score): its first k rows of another label."""
        others = np.flatnonzero((self.labels != label) & (self.ids != i))
        a, b = low[others], high[others]
        chosen = []
        for least, greatest in windows:
            may = (b >= least) & (a <= greatest)
            sure = a[may & (a >= least) & (b <= greatest)]
            if len(sure) >= k:
                may &= b >= np.partition(sure, -k)[-k]
            chosen.append(may)
        some = np.logical_or.reduce(chosen) if chosen else np.zeros(len(others), bool)
        scores = np.zeros(len(others), np.int64)
        scores[some] = self.exact(others[some], q)
        out = []
        for (least, greatest), may in zip(windows, chosen):
            on = np.flatnonzero(may)
            on = on[(scores[on] >= least) & (scores[on] <= greatest)]
            out.append(self.best(others[on], scores[on], k))
        return out


def integers(rows: DataFrame, ident: str, vector: str, label: str, scale: int) -> DataFrame:
    """Rows that take part, once each: i long, l long, v array<long>."""
    x = rows.select(F.col(ident).cast("long").alias("i"), F.col(label).cast("long").alias("l"), F.col(vector).cast("array<double>").alias("x"))
    x = x.where("i is not null and l is not null and x is not null and size(x) > 0")
    x = x.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return x.select("i", "l", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v")).distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch cut where (shard, dim, kind) changes."""
    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield tuple(keys[:, start].tolist()), b.slice(start, end - start)


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _visited(rows: DataFrame, anchors: DataFrame, shards: int, found: Callable, schema: str) -> DataFrame:
    """found(file, anchors' ids, labels, vectors, lower and upper bounds, w lists) for each block of anchors and each shard."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, file = None, [], None
        for (shard, dim, kind), b in _runs(batches):
            if at != (shard, dim):
                at, held, file = (shard, dim), [], None
            if kind == 0:
                held.append((b.column("i").to_numpy(), b.column("l").to_numpy(), _vectors(b, dim)))
                continue
            if not held:
                continue
            if file is None:
                file = VAFile(*(np.concatenate(x) for x in zip(*held)))
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                q = _vectors(part, dim)
                low, high = file.bounds(q)
                yield found(file, part.column("i").to_pylist(), part.column("l").to_pylist(), q, low, high, part.column("w").to_pylist())

    none = F.lit(None).cast("array<struct<p:long,s:long>>")
    both = rows.select(F.pmod(F.xxhash64("i", "v", "l"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "i", "l", "v", none.alias("w"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("dim"), F.lit(1).alias("kind"), "i", "l", "v", "w")
    dealt = both.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "kind")
    return dealt.mapInArrow(visit, schema)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, ident: str = "vec_id", vector: str = "embedding", label: str = "label", shards: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the best rows of its label; their negatives the first rows of other labels whose score
    lies between low and high percent of the positive's.
    """
    spark = rows.sparkSession
    kept = runtime.written(integers(rows, ident, vector, label, scale), "vectors")
    asked = integers(anchors, ident, vector, label, scale).groupBy("i").agg(F.min(F.struct("v", "l")).alias("x")).select("i", "x.l", "x.v")
    asked = runtime.written(asked, "anchors")
    n = kept.count()
    shards = shards or max(1, -(-n // SHARD_ROWS), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism))

    def first(file: VAFile, ids: list, labels: list, q: np.ndarray, least: np.ndarray, most: np.ndarray, _: list) -> pa.RecordBatch:
        got = [file.positives(i, l, x, least[:, j], most[:, j], positives) for j, (i, l, x) in enumerate(zip(ids, labels, q))]
        names = np.repeat(np.array(ids, np.int64), [len(x[0]) for x in got])
        return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(np.concatenate(x)) for x in zip(*got))], ["i", "p", "s"])

    def second(file: VAFile, ids: list, labels: list, q: np.ndarray, least: np.ndarray, most: np.ndarray, wanted: list) -> pa.RecordBatch:
        out = []
        for j, (i, l, x, w) in enumerate(zip(ids, labels, q, wanted)):
            windows = [(-(-low * e["s"] // 100), high * e["s"] // 100) for e in w]
            for e, (ids_, scores) in zip(w, file.negatives(i, l, x, least[:, j], most[:, j], negatives, windows)):
                out.append((np.full(len(ids_), i), np.full(len(ids_), e["p"]), np.full(len(ids_), e["s"]), ids_, scores))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    empty = asked.withColumn("w", F.lit(None).cast("array<struct<p:long,s:long>>"))
    near = _visited(kept, empty, shards, first, "i long, p long, s long")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "p"))).where(F.col("r") <= positives)
    windows = near.groupBy("i").agg(F.collect_list(F.struct("p", "s")).alias("w"))
    found = _visited(kept, runtime.written(asked.join(windows, "i"), "windows"), shards, second, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
