"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Vectors are turned into integers floor(scale * x). Candidates are dealt into shards of bounded size by a hash of the row.
A shard's rows come into a task once; its ball tree is built once, and all queries (the stated query set against all
rows) then pass through it a block at a time: only queries are copied, once for each shard. Before that, every query is
scored against a bounded sample of rows; the kth score it finds there is its threshold in all shards, so that their
trees are pruned from the start, by one score that all shards share. In a tree, a block carries each query's current kth
score on. Nodes are visited in the order of their bound q.c + |q| r; a node is left out only if its bound is below the
kth score, so ties stay exact. The shards' k best are merged by a window over at most k rows a shard for each query.

Defined cases: a vector that is null, empty, or holds a null or non-finite component, and a row with a null id, takes
no part; vectors of another length than the query's are no candidates of it; equal (id, vector) rows count once; a
query with fewer candidates than k returns all; an empty table gives no row. Scores over 2**53 are summed as wrapping
64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import runtime

#: Vectors in a shard (expected; and the least for which another is opened), in a leaf, queries in a block; rows of the sample that gives thresholds.
SHARD_ROWS, LEAST_ROWS, LEAF_ROWS, BLOCK_ROWS, SAMPLE_ROWS = 32_768, 1024, 128, 512, 2048
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """A balanced binary tree over integer vectors; nodes are stored level by level, leaves last."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        order, bounds = np.arange(len(ids)), [0, len(ids)]
        real = vectors.astype(np.float64)
        self.levels = []
        for level in range(depth + 1):
            at = np.array(bounds)
            centre = np.stack([real[order[a:b]].mean(0) if b > a else np.zeros(real.shape[1]) for a, b in zip(at[:-1], at[1:])])
            radius = np.array([np.sqrt(((real[order[a:b]] - c) ** 2).sum(1).max()) if b > a else 0.0 for a, b, c in zip(at[:-1], at[1:], centre)])
            self.levels.append((centre, radius))
            if level == depth:
                break
            bounds = [0]
            for a, b in zip(at[:-1], at[1:]):
                part = real[order[a:b]]
                if b - a > 1:  # split at the median along the line between two far points
                    one = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
                    two = part[((part - one) ** 2).sum(1).argmax()]
                    order[a:b] = order[a:b][np.argsort(part @ (two - one), kind="stable")]
                bounds += [(a + b) // 2, b]
        self.at, self.ids, self.vectors = np.array(bounds), ids[order], vectors[order]
        self.exact = real[order]

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> None:
        """Merge into best (scores, ids: queries x k, sorted; missing: lowest score, largest id) what this tree holds."""
        scores, ids = best
        real, norm = q.astype(np.float64), np.sqrt((q.astype(np.float64) ** 2).sum(1))
        small = len(self.ids) and float(np.abs(self.exact).max(initial=0)) * float(np.abs(real).max(initial=0)) * q.shape[1] < 2**53
        live = np.ones((len(q), 1), bool)
        for centre, radius in self.levels:  # a child is looked at where its parent's bound allows it
            if live.shape[1] != len(radius):
                live = np.repeat(live, 2, axis=1)
            bound = real @ centre.T + norm[:, None] * radius
            bound += 1e-9 * np.abs(bound) + 1
            live &= bound >= scores[:, -1:].astype(np.float64)
        order = np.argsort(-np.where(live, bound, -np.inf), axis=1, kind="stable")
        for step in range(order.shape[1]):
            leaf = order[:, step]
            on = np.flatnonzero(live[np.arange(len(q)), leaf] & (bound[np.arange(len(q)), leaf] >= scores[:, -1]))
            if not len(on):
                if not (live[np.arange(len(q)), leaf]).any():
                    break
                continue
            on = on[np.argsort(leaf[on], kind="stable")]
            cuts = np.flatnonzero(np.diff(leaf[on])) + 1
            for rows in np.split(on, cuts):
                a, b = self.at[leaf[rows[0]]], self.at[leaf[rows[0]] + 1]
                found = (real[rows] @ self.exact[a:b].T).astype(np.int64) if small else q[rows] @ self.vectors[a:b].T
                own = np.broadcast_to(self.ids[a:b], found.shape)
                low = np.iinfo(np.int64).min
                found = np.where(own == q_ids[rows, None], low, found)
                both = np.concatenate((scores[rows], found), 1)
                names = np.concatenate((ids[rows], np.where(found == low, np.iinfo(np.int64).max, own)), 1)
                top = np.lexsort((names, -both.astype(np.float64) if small else ~both), axis=1)[:, :k]
                scores[rows], ids[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)


def integers(rows: DataFrame, ident: str, vector: str, scale: int) -> DataFrame:
    """Rows that take part, once each: i long, v array<long>."""
    x = rows.select(F.col(ident).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("x")).where("i is not null and x is not null and size(x) > 0")
    x = x.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return x.select("i", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v")).distinct()


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch cut where one of its first columns changes."""
    for b in batches:
        at = np.stack([b.column(c).to_numpy() for c in range(keys)])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield tuple(at[:, start].tolist()), b.slice(start, end - start)


def _thresholds(asked: DataFrame, sample: list, k: int) -> DataFrame:
    """asked with low: the kth score of each query among a bounded sample of rows, or the least integer."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["v"]) for r in sample}:
        own = [r for r in sample if len(r["v"]) == dim]
        by_dim[dim] = np.array([r["i"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), b in _runs(batches, 1):
            ids, low = b.column("i").to_numpy(), np.full(b.num_rows, _LOW)
            held, vectors = by_dim.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
            q = _vectors(b, dim)
            for start in range(0, len(ids) if len(held) > k else 0, BLOCK_ROWS):  # one of them may be the query itself
                part = slice(start, start + BLOCK_ROWS)
                scores = np.where(held == ids[part, None], _LOW, q[part] @ vectors.T)
                low[part] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("i"), b.column("v"), pa.array(low)], ["dim", "i", "v", "low"])

    return asked.select(F.size("v").alias("dim"), "i", "v").mapInArrow(run, "dim int, i long, v array<long>, low long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, ident: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other rows."""
    spark = vectors.sparkSession
    rows, asked = runtime.written(integers(vectors, ident, vector, scale), "vectors"), integers(queries, ident, vector, scale)
    n = rows.count()
    shards = shards or max(1, -(-n // SHARD_ROWS), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism))
    sample = rows.orderBy(F.xxhash64("i", "v")).limit(SAMPLE_ROWS).collect() if n > SAMPLE_ROWS else []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for (shard, dim, kind), b in _runs(batches, 3):
            if at != (shard, dim):
                at, held, tree = (shard, dim), [], None
            if kind == 0:
                held.append((b.column("i").to_numpy(), _vectors(b, dim)))
                continue
            if not held:
                continue
            if tree is None:
                tree = BallTree(*(np.concatenate(x) for x in zip(*held)))
                held = [()]
            for start in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(start, BLOCK_ROWS)
                q_ids, low = part.column("i").to_numpy(), part.column("low").to_numpy()
                # ties with the threshold may still be among the k best, so places are filled with what lies just below it
                scores = np.repeat(np.maximum(low, _LOW + 1)[:, None] - 1, k, 1)
                ids = np.full((len(q_ids), k), _HIGH)
                tree.search(q_ids, _vectors(part, dim), k, (scores, ids))
                real = (ids != _HIGH) & (scores >= low[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], ids.shape)[real]), pa.array(ids[real]), pa.array(scores[real])], ["query_id", "vec_id", "score"])

    shard = F.pmod(F.xxhash64("i", "v"), F.lit(shards)).cast("int").alias("shard")
    stored = rows.select(shard, F.size("v").alias("dim"), F.lit(0).alias("kind"), "i", "v", F.lit(0).cast("long").alias("low"))
    copies = _thresholds(asked, sample, k).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("kind"), "i", "v", "low")
    dealt = stored.unionByName(copies).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "kind")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
