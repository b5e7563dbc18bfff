"""Removal of repeated byte strings by a sampled suffix array with bucket-pointer refinement.

Every byte that lies in a string of `length` bytes which also starts elsewhere, in the same or another document, goes.
A window of that length belongs to its minimiser, the 32-byte gram in it with the least hash, so equal windows meet in
the bucket of one gram and lie the same way around it. Only minimisers are shuffled, one for about 85 bytes: a mark
names its gram (the initial bucket) and hashes the bytes of all windows that share it (its context).

* A gram that occurs once has no repeated window. Counts come from a partial aggregate, so no gram is hot.
* A gram whose contexts are all equal has repeated windows only.
* The other buckets are refined, with one text for each different context: bucket identifiers of 8 bytes are refined by
  sorting on the identifier 8 bytes on; the new identifiers, of 16 bytes, are used again for the next 16, and so forth,
  until they name `length` bytes. Buckets that hold one suffix are left alone. Windows that share a last identifier are
  repeated. Many buckets are refined in one array of bounded size.
* Buckets of over BIG contexts are not gathered: their windows are hashed one by one and counted by an aggregate.

Contexts and windows are told apart by 128 bits of hash. Documents are named by hashes of their id and text; texts are
read again for the contexts and for the result, and shuffled both times, at every size alike.

Defined cases: a null text counts as empty; equal rows (ids included) count as two documents, whose strings are all
repeated; ids may be null or repeat; long texts are taken in slices of SLICE windows; an empty table gives no row;
other columns are dropped. Cut UTF-8 characters stay cut: `kept` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm import arrays

#: Bytes of a gram (a multiple of 8); windows taken at once from a long text; bytes refined at once; contexts from which a bucket is not gathered.
GRAM, SLICE, ARRAY_BYTES, BIG = 32, 1 << 19, 1_000_000, 4096

_BASE = int(arrays.multipliers(1, 77)[0])
_TURNS = arrays.multipliers(64, 5)


@lru_cache(4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i, wrapping."""
    ways = []
    for x in (base, pow(base, -1, 1 << 64)):
        out = np.full(n, x, np.uint64)
        out[0] = 1
        ways.append(np.multiply.accumulate(out))
    return ways[0], ways[1]


def grams(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as an integer."""
    x = raw.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


def stretches(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of symbols[start:end], alike wherever they stand."""
    size = 1 << int(len(symbols)).bit_length()
    up, down = _powers(size, base)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    return arrays.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def marks(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, minimiser's place, windows start this far before it: from, to, gram hash, context hash) of each run of windows.

    raw, at: concatenated documents and their offsets, at most 2**21 bytes.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(raw) < length:
        return none
    symbols = arrays.mix(grams(raw))
    gram = np.zeros(len(raw) - GRAM + 1, np.uint64)
    for i in range(GRAM // 8):
        gram += symbols[8 * i : 8 * i + len(gram)] * _TURNS[i]
    gram = arrays.mix(gram)
    low = np.uint64((1 << 21) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & low).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    for cut in (at[:-1], at[1:] - length + 1):
        first[cut[(cut >= 0) & (cut < len(first))]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(first)) - 1
    doc = np.searchsorted(at, start, "right") - 1
    whole = at[doc + 1] - start >= length
    start, end, doc = start[whole], end[whole], doc[whole]
    place = place[start]
    context = stretches(symbols, start, end + length - 7)
    context = arrays.mix(context + (place - start).astype(np.uint64) * _TURNS[8])
    return doc, place - at[doc], place - start, place - end, gram[place], context


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(rows, place of the first byte in its text, bytes, offsets): runs of whole texts, or slices of a long one."""
    for a, b, raw, at in arrays.chunks(column, SLICE):
        if len(raw) <= SLICE + length:
            yield np.arange(a, b), 0, raw, at
            continue
        for s in range(0, len(raw) - length + 1, SLICE):
            part = raw[s : s + SLICE + length - 1]
            yield np.array([a]), s, part, np.array([0, len(part)])


def _marked(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k = batch.column("d").to_numpy(), batch.column("k").to_numpy()
            for rows, at0, raw, at in _pieces(batch.column("x"), length):
                doc, place, far, near, gram, context = marks(raw, at, length)
                packed = (place + at0) << 16 | far << 8 | near
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[rows[doc]], k[rows[doc]], packed, gram.view(np.int64), context.view(np.int64))], ["d", "k", "m", "b", "c"])

    return run


def _cut(length: int):
    """Contexts of the marks named in w: b, c, n, far, near, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at, data = arrays.strings(batch.column("x"))[::-1]
            for i, (d, k, w) in enumerate(zip(batch.column("d").to_pylist(), batch.column("k").to_pylist(), batch.column("w").to_pylist())):
                if (d, k) in seen:  # an equal row
                    continue
                seen.add((d, k))
                raw = data[at[i] : at[i + 1]].tobytes()
                m = [x["m"] for x in w]
                texts = [raw[(x >> 16) - (x >> 8 & 255) : (x >> 16) - (x & 255) + length] for x in m]
                yield pa.RecordBatch.from_arrays([pa.array([x["b"] for x in w]), pa.array([x["c"] for x in w]), pa.array([x["n"] for x in w]), pa.array([x >> 8 & 255 for x in m], pa.int32()), pa.array([x & 255 for x in m], pa.int32()), pa.array(texts, pa.binary())], ["b", "c", "n", "far", "near", "x"])

    return run


def identifiers(raw: np.ndarray, length: int) -> np.ndarray:
    """A number for each place whose `length` bytes lie within raw, equal where these are, by bucket-pointer refinement."""
    _, own = np.unique(grams(raw), return_inverse=True)
    size, own = 8, own.astype(np.int64)
    while size < length:
        step = min(size, length - size)
        later = own[step:]
        now = own[: len(later)]
        crowd = np.flatnonzero(np.bincount(now)[now] > 1)  # buckets of one suffix are settled
        _, parts = np.unique(now[crowd] * (int(own.max(initial=0)) + 1) + later[crowd], return_inverse=True)
        fresh = now + int(parts.max(initial=-1)) + 1  # settled ones keep apart from the refined
        fresh[crowd] = parts
        own, size = fresh, size + step
        _, own = np.unique(own, return_inverse=True) if len(own) and own.max() > 4 * len(own) else (None, own)
    return own


def _refined(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            b, c, n, far, near, x = zip(*held)
            at = np.cumsum([0, *map(len, x)])
            own = identifiers(np.frombuffer(b"".join(x), np.uint8), length)
            runs = np.array(far) - np.array(near) + 1
            row = np.repeat(np.arange(len(x)), runs)
            step = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
            found = own[at[row] + step]
            repeated = np.bincount(found, np.array(n, float)[row])[found] > 1
            first = repeated.copy()
            first[1:] &= ~(repeated[:-1] & (row[1:] == row[:-1]))
            stop = repeated.copy()
            stop[:-1] &= ~(repeated[1:] & (row[1:] == row[:-1]))
            start, end = np.flatnonzero(first), np.flatnonzero(stop)
            own_row, ahead = row[start], np.array(far)[row[start]]
            runs_ = (ahead - step[start]) << 8 | (ahead - step[end])
            cuts = np.searchsorted(own_row, np.arange(len(x) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(runs_, pa.int32()))
            keep = pa.array(np.diff(cuts) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(c), lists], ["b", "c", "runs"]).filter(keep)

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("b", "c", "n", "far", "near", "x"))):
                if row[0] != last and size >= ARRAY_BYTES:
                    yield from done(held)
                    held, size = [], 0
                last, size = row[0], size + len(row[5])
                held.append(row)
        yield from done(held)

    return run


def _windows(length: int):
    """b, c, j, n and two hashes of each window of a context; j: how far it starts before the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, c, n, far, near, x in zip(*(batch.column(y).to_pylist() for y in ("b", "c", "n", "far", "near", "x"))):
                symbols, start = arrays.mix(grams(np.frombuffer(x, np.uint8))), np.arange(far - near + 1)
                hashes = [stretches(arrays.mix(symbols ^ _TURNS[9 + i]), start, start + length - 7).view(np.int64) for i in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), b)), pa.array(np.full(len(start), c)), pa.array(far - start, pa.int32()), pa.array(np.full(len(start), n)), *map(pa.array, hashes)], ["b", "c", "j", "n", "h", "g"])

    return run


def _spread(docs: DataFrame, length: int) -> DataFrame:
    """d, k, w: the runs of repeated windows of each document that has one, packed as marks are."""
    long = docs.where(F.octet_length("x") >= length)
    found = runtime.written(long.mapInArrow(_marked(length), "d long, k long, m long, b long, c long"), "marks")
    buckets = found.groupBy("b").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1")
    hits = runtime.written(runtime.spread_join(found, runtime.written(buckets, "buckets"), ["b"]), "hits")
    mixed = hits.where("mixed").drop("mixed")
    classes = runtime.written(mixed.groupBy("b", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "m")).alias("rep")), "contexts")
    wanted = classes.groupBy("rep.d", "rep.k").agg(F.collect_list(F.struct("rep.m", "b", "c", "n")).alias("w"))
    texts = long.join(wanted, ["d", "k"]).mapInArrow(_cut(length), "b long, c long, n long, far int, near int, x binary")
    big = runtime.written(classes.groupBy("b").count().where(F.col("count") > BIG).select("b"), "big")
    some = big.limit(1).count() > 0
    if some:
        texts = runtime.written(texts, "context_texts")
    usual = texts.join(runtime.sized(big), "b", "left_anti") if some else texts
    runs = usual.repartition("b").sortWithinPartitions("b").mapInArrow(_refined(length), "b long, c long, runs array<int>")
    if some:
        each = runtime.written(texts.join(runtime.sized(big), "b", "left_semi").mapInArrow(_windows(length), "b long, c long, j int, n long, h long, g long"), "windows")
        total = each.groupBy("h", "g").agg(F.sum("n").alias("total"), F.count("*").alias("n")).where("total > 1").drop("total")
        again = runtime.spread_join(each.drop("n"), runtime.written(total, "repeated"), ["h", "g"])
        runs = runs.unionByName(again.groupBy("b", "c").agg(F.transform(F.collect_set("j"), lambda j: j * 256 + j).alias("runs")))
    sizes = classes.select("b", "c", "n")
    back = runtime.spread_join(mixed, runtime.written(runs.join(sizes, ["b", "c"]), "runs"), ["b", "c"])
    spread = back.select("d", "k", "m", F.explode("runs").alias("r")).select("d", "k", (F.shiftleft(F.shiftright("m", 16), 16) + F.col("r")).alias("m"))
    both = hits.where("not mixed").select("d", "k", "m").unionByName(spread)
    return runtime.written(both.groupBy("d", "k").agg(F.collect_set("m").alias("w")), "spans")


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = arrays.strings(batch.column("x"))
            lists = batch.column("w").to_pylist()
            start, size, most = 0, 0, arrays.CHUNK_BYTES
            for i in range(batch.num_rows):
                size += int(at[i + 1] - at[i])
                if size < most and i + 1 < batch.num_rows:
                    continue
                spans, kept, counts = [], [], []
                for j in range(start, i + 1):
                    own = raw[at[j] : at[j + 1]]
                    w = np.sort(np.array(lists[j] or [], np.int64))
                    a, b = (w >> 16) - (w >> 8 & 255), (w >> 16) - (w & 255) + length
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
                    first = np.ones(len(a), bool)
                    first[1:] = a[1:] > b[:-1]
                    ends = np.append(np.flatnonzero(first)[1:], len(a)) - 1 if len(a) else np.zeros(0, np.int64)
                    a, b = a[first], b[ends]
                    spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                    stays = np.ones(len(own), bool)
                    for x, y in zip(a.tolist(), b.tolist()):
                        stays[x:y] = False
                    kept.append(own[stays].tobytes())
                    counts.append((len(own), int((b - a).sum()), len(a)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, i + 1 - start), *(pa.array(x, pa.int64()) for x in zip(*counts)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
                start, size = i + 1, 0

    return run


def deduplicated(docs: DataFrame, length: int = 200, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, n_bytes, n_removed, n_spans, spans (start and end byte of each removed run), kept (the other bytes); length from 48 to 255 + 32."""
    if not GRAM + 16 <= length < GRAM + 255:
        raise ValueError("length must lie between 48 and 286 bytes")
    x = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(ident).alias("id"), x.alias("x"), F.xxhash64(ident).alias("d"), F.xxhash64(x).alias("k"))
    spans = _spread(named.select("x", "d", "k"), length)
    kind = docs.schema[ident].dataType.simpleString()
    out = named.join(spans, ["d", "k"], "left").mapInArrow(_removed(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", ident)
