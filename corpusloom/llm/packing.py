"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents are dealt into shards of about SHARD_ROWS by a hash, so that no source or group of copies decides a task's
size. In a shard they come by falling length; bins stand in the order of their residual capacity and carry a bitmap of
their sources and one of their duplicate clusters. The search starts at the tightest bin that has room and goes on to
the next larger residual until bin and document share no source and no cluster; where none is left, a bin is opened.
A document longer than a bin first fills bins of its own; what remains is packed like any other.

A document's length is its words ([^\\x20\\x09-\\x0D]+) and one end token. A cluster holds the texts with the same words
after lower-casing A-Z, unless a cluster column is named. Defined cases: a null or empty text is its end token; a null
source conflicts with none; equal lengths go by doc_id (null first), then by hash; repeated rows are packed each, in
different bins, as they are copies; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm.arrays import Words, chunks, mix, sums

CAPACITY, SHARD_ROWS = 2048, 4096


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, place in the bin) of each item, in the given order; sources and clusters are bitmaps."""
    free: list[tuple[int, int]] = []  # (residual, bin), in order
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    least, out = min(lengths, default=0), []
    for n, s, c in zip(lengths, sources, clusters):
        at = bisect_left(free, (n, -1))
        while at < len(free) and (bin_sources[free[at][1]] & s or bin_clusters[free[at][1]] & c):
            at += 1
        if at < len(free):
            room, b = free.pop(at)
            bin_sources[b] |= s
            bin_clusters[b] |= c
        else:
            room, b = capacity, len(bin_sources)
            bin_sources.append(s)
            bin_clusters.append(c)
        out.append((b, capacity - room))
        if room - n >= least:
            insort(free, (room - n, b))
    return out


def _bits(values: list, often: bool) -> list[int]:
    """A bit for each distinct value (only for values that occur twice or more, if often); 0 for null."""
    count = Counter(v for v in values if v is not None)
    bit = {v: 1 << i for i, v in enumerate(sorted(v for v in count if not often or count[v] > 1))}
    return [bit.get(v, 0) for v in values]


def described(documents: DataFrame, cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster (hash) and n_tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, raw, at in chunks(b.column(1)):
                w = Words(raw, at)
                h, n = w.hashes(), np.diff(w.at)
                place = np.arange(len(h)) - np.repeat(w.at[:-1], n)
                own = sums(mix(h + mix(place.astype(np.uint64) + np.uint64(1))), w.at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), b.column(2).slice(start, end - start), pa.array(mix(own + n.astype(np.uint64)).view(np.int64)), pa.array(n + 1)], ["doc_id", "source", "cluster", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), *([F.xxhash64(cluster).alias("named")] if cluster else []))
    if cluster:
        return rows.select("doc_id", "source", F.col("named").alias("cluster"), (F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")) + 1).cast("long").alias("n_tokens"))
    return rows.mapInArrow(run, "doc_id long, source string, cluster long, n_tokens long")


def packed(documents: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: str | None = None) -> DataFrame:
    """bin_id, bin_start, doc_id, piece, doc_start, n_tokens, source: one row for each document or piece of one."""
    rows = runtime.written(described(documents, cluster), "lengths")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        docs, sources, clusters, sizes = (t.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n_tokens"))
        order = sorted(range(len(docs)), key=lambda i: (-(sizes[i] % capacity or capacity), docs[i] is not None, docs[i] or 0, clusters[i], sources[i] is not None, sources[i] or "", sizes[i]))
        of_source, of_cluster = _bits(sources, False), _bits(clusters, True)
        left = [sizes[i] % capacity or capacity for i in order]
        places = best_fit(left, [of_source[i] for i in order], [of_cluster[i] for i in order], capacity)
        used, out = max((b for b, _ in places), default=-1) + 1, []
        for i, n, (b, at) in zip(order, left, places):
            full = (sizes[i] - n) // capacity
            for k in range(full):
                out.append((used, 0, docs[i], k, k * capacity, capacity, sources[i]))
                used += 1
            out.append((b, at, docs[i], full, full * capacity, n, sources[i]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*out))
        columns[0] = tuple((shard << 32) + b for b in columns[0])
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bin_id", "bin_start", "doc_id", "piece", "doc_start", "n_tokens", "source"])

    return dealt.groupBy("shard").applyInArrow(pack, "bin_id long, bin_start long, doc_id long, piece int, doc_start long, n_tokens long, source string")
