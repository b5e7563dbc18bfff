"""An interpolated modified Kneser-Ney trigram model: counted in Spark, kept as sorted hash arrays that workers map.

Tokens are the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end for each text; two starts stand before
it. A word's id is a 48-bit hash (a billion distinct words would hold about 2,000 clashing pairs).

Counting. Every task turns FLUSH tokens at a time into distinct trigrams with counts, one binary row for each bucket,
in which the OFTEN most frequent words have names of two bytes.
A trigram (u, v, w) lies in the bucket of its middle word v, so that the followers of the context (u, v) and the words
before the pair (v, w) are counted where it lies. Trigrams whose middle word has more than a quarter of a bucket's
share of all tokens are dealt by their own hash instead; what each bucket knows of their contexts and pairs are sums,
which a second step adds up by the hash of context or pair. So no word and no word pair, however frequent, gathers in
one bucket. Of each bucket, tables of trigrams, contexts, pairs and words are written to the shared folder (under
another name first, so a task may run twice), and scoring tasks map these files. The driver receives one row of sums
for each bucket.

A table holds sorted hashes: the leading bits choose a slot, the next 32 are stored, and a byte tells the value, or that
it stands in a list of rare ones. A trigram that was not counted is taken for another with a chance of about 2**-28.

spark.checkpoint.dir must be a folder that is mounted on all machines, as the files are mapped into memory.

Defined cases: a null or empty text is its end alone; repeated rows are counted and scored each; without training
rows, all scores are 0 (one token type, the unknown one); other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm.arrays import Words, chunks, mix, remainder, sums

#: Tokens that a task counts at a time.
FLUSH = 2_000_000
#: Frequent words that have short names (at most 65,535; they are broadcast).
OFTEN = 65_535
#: Bytes of text behind each bucket.
BUCKET_BYTES = 16_000_000
_ROW = "bucket int, kind int, payload binary"
COUNTS, FOLLOWED, CONTINUED, TOTALS, HOT_CONTEXTS, HOT_PAIRS = range(6)
TABLES = ("words", "trigrams", "contexts", "pairs", "hot-contexts", "hot-pairs")


def _id(n: int) -> int:
    return int(mix(np.array([n], np.uint64))[0] >> np.uint64(16))


END, START = _id(11), _id(12)


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as bytes, the bytes of equal weight side by side, compressed."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    head = np.array([len(body), len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<u4").tobytes()
    return head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def _load(data: bytes) -> list[np.ndarray]:
    size, k = (int(x) for x in np.frombuffer(data, "<u4", 2))
    shape = np.frombuffer(data, "<u4", 2 * k, 8).astype(np.int64)
    body = np.frombuffer(pa.decompress(data[8 + 8 * k :], decompressed_size=size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for n, width in zip(shape[::2], shape[1::2]):
        out.append(np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += n * width
    return out


class Names:
    """Short names of frequent words: two bytes for each of the OFTEN most frequent ones; other words are listed behind."""

    def __init__(self, by_rank: np.ndarray):
        self.by_rank = by_rank
        self.rank_of = np.argsort(by_rank)
        self.ids = by_rank[self.rank_of]

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.rank_of[at], OFTEN).astype("<u2")

    def short(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.ranks(ids)
        return rank, ids[rank == OFTEN]

    def long(self, rank: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = self.by_rank[np.minimum(rank, len(self.by_rank) - 1)]
        out[rank == OFTEN] = others
        return out


def _summed(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ids in order, and the sums of their values (1 each if none is given)."""
    order = np.argsort(ids)
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    if not values:
        return ids[first], np.diff(np.concatenate((first, [len(ids)])))
    return (ids[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) ^ mix(w + np.uint64(3)))


def _range(ids: np.ndarray, buckets: int, bits: int = 48) -> np.ndarray:
    """Bucket of each id by its place in the range."""
    return ((ids >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def sequences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, second, third words, n + 1 offsets by text) of the trigrams of runs of texts, from two STARTs to END."""
    for _, _, raw, at in chunks(column):
        words = Words(raw, at)
        ids, own = words.hashes() >> np.uint64(16), words.at + np.arange(len(words.at))
        v, w = np.insert(ids, words.at[:-1], np.uint64(START)), np.insert(ids, words.at[1:], np.uint64(END))
        u = np.concatenate(([np.uint64(START)], v[:-1]))
        u[own[:-1]] = START
        yield u, v, w, own


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "payload"])


def _cut(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the runs of a sorted array."""
    at = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else []
    for a, b in zip(at, [*at[1:], len(buckets)]):
        yield int(buckets[a]), int(a), int(b)


def _dealt(kind: int, buckets: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A row of these arrays for each bucket."""
    order = np.argsort(buckets, kind="stable")
    arrays = [a[order] for a in arrays]
    return [(b, kind, _dump(*(a[i:j] for a in arrays))) for b, i, j in _cut(buckets[order])]


def _dealt_pairs(kind: int, names: Names, nb: int, hot: np.ndarray, other: np.ndarray, h: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A row of word pairs, in the order of their hot words, and columns for each bucket of their hashes."""
    buckets = _range(h, nb, 64)
    order = np.lexsort((hot, buckets))
    hot, other, columns = hot[order], other[order], [c[order] for c in columns]
    return [(b, kind, _dump(*names.short(hot[i:j]), *names.short(other[i:j]), *(c[i:j] for c in columns))) for b, i, j in _cut(buckets[order])]


def _loaded_pairs(names: Names, data: bytes) -> list[np.ndarray]:
    a, a_others, b, b_others, *columns = _load(data)
    return [names.long(a, a_others), names.long(b, b_others), *columns]


def _save(folder: str, name: str, *parts: np.ndarray) -> None:
    """Arrays in one file that appears whole."""
    to = os.path.join(folder, name)
    with open(own := f"{to}.{uuid.uuid4().hex}", "wb") as f:
        f.write(np.array([len(x) for x in parts] + [0] * (8 - len(parts)), "<u8").tobytes())
        for x in parts:
            f.write(np.ascontiguousarray(x).tobytes())
            f.write(b"\0" * (-x.nbytes % 8))
    os.replace(own, to)


def _map(folder: str, name: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file that was written; one that is not there is an error, as its counts are not 0."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: spark.checkpoint.dir must be mounted on all machines")
    whole = np.memmap(path, np.uint8, "r").view(np.ndarray)
    out, at = [], 64
    for n, kind in zip(whole[:64].view("<u8"), kinds):
        size = int(n) * np.dtype(kind).itemsize
        out.append(whole[at : at + size].view(kind))
        at += size + -size % 8
    return out


TABLE, WORDS = ["<u4", "<u4", "u1", "<u8", "<u4", "<u8"], ["<u8", "<u8", "<u4", "<u8", "<u4", "<u4", "<u4"]


def _turned(h: np.ndarray) -> np.ndarray:
    """The hash with its halves changed, as the upper one has chosen the bucket."""
    return h << np.uint64(32) | h >> np.uint64(32)


def table(h: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Arrays of a table of distinct hashes and one to four columns of counts."""
    key = _turned(h)
    order = np.argsort(key)
    key, columns = key[order], [c[order].astype(np.uint64) for c in columns]
    bits = max(1, min(31, len(key).bit_length() - 3))
    slots = np.searchsorted((key >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1)).astype("<u4")
    fits, packed = np.ones(len(key), bool), np.zeros(len(key), np.uint64)
    for c in columns:
        fits &= c < 1 << 16
        packed = packed << np.uint64(16) | c & np.uint64(0xFFFF)
    kinds, n = np.unique(packed[fits], return_counts=True)
    common = np.sort(kinds[np.argsort(-n, kind="stable")[:255]]) if len(kinds) else np.zeros(1, np.uint64)
    code = np.minimum(np.searchsorted(common, packed), len(common) - 1)
    rare = np.flatnonzero(~fits | (common[code] != packed))
    code[rare] = 255
    return [slots, (key >> np.uint64(32 - bits)).astype("<u4"), code.astype(np.uint8), common, rare.astype("<u4"), np.stack([c[rare] for c in columns], 1).reshape(-1)]


def looked_up(parts: list[np.ndarray], h: np.ndarray, k: int) -> list[np.ndarray]:
    """The k columns of each hash; 0 where the table lacks it."""
    slots, tails, codes, common, rare, values = parts
    key, bits = _turned(h), (len(slots) - 1).bit_length() - 1
    slot, tail = (key >> np.uint64(64 - bits)).astype(np.int64), (key >> np.uint64(32 - bits)).astype(np.uint32)
    low, end = slots[slot].astype(np.int64), slots[slot + 1].astype(np.int64)
    high = end
    for _ in range(int((end - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (low < high) & (tails[np.minimum(middle, len(tails) - 1)] < tail)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    hit = np.flatnonzero((low < end) & (tails[np.minimum(low, len(tails) - 1)] == tail))
    at = low[hit]
    code = codes[at]
    packed = common[np.minimum(code, len(common) - 1)]
    odd = np.flatnonzero(code == 255)
    odd = odd[rare[np.minimum(np.searchsorted(rare, at[odd]), len(rare) - 1)] == at[odd]] if len(rare) else odd[:0]
    where, out = np.searchsorted(rare, at[odd]), []
    for i in range(k):
        value = (packed >> np.uint64(16 * (k - 1 - i)) & np.uint64(0xFFFF)).astype(np.float64)
        value[odd] = values[where * k + i]
        full = np.zeros(len(h))
        full[hit] = value
        out.append(full)
    return out


@dataclass
class Model:
    folder: str
    buckets: int
    hot: np.ndarray  # sorted ids of the middle words whose trigrams are dealt by their own hash
    tokens: int
    types: int
    discounts: list[np.ndarray]  # of words, pairs and trigrams with counts 0, 1, 2 and 3 or more
    continuations: int
    written: dict[str, frozenset[int]]  # buckets that have a file, by table
    word_mass: float  # share of the lowest order that the uniform distribution gets

    def _file(self, name: str, bucket: int, files: dict) -> list[np.ndarray] | None:
        if bucket not in self.written[name]:
            return None
        if (name, bucket) not in files:
            files[name, bucket] = _map(self.folder, f"{name}-{bucket:06d}", WORDS if name == "words" else TABLE)
        return files[name, bucket]

    def _words(self, ids: np.ndarray, files: dict) -> list[np.ndarray]:
        """Of sorted distinct ids: count, continuations; sum of the continuations of the pairs they begin, and the numbers of those with 1, 2, 3 or more."""
        out = [np.zeros(len(ids)) for _ in range(6)]
        for b, i, j in _cut(_range(ids, self.buckets)):
            f = self._file("words", b, files)
            if f is not None:
                at = np.minimum(np.searchsorted(f[0], ids[i:j]), len(f[0]) - 1)
                hit = f[0][at] == ids[i:j]
                for o, column in zip(out, f[1:]):
                    o[i:j] = np.where(hit, column[at], 0)
        return out

    def _of(self, name: str, bucket: np.ndarray, h: np.ndarray, k: int, files: dict) -> list[np.ndarray]:
        """k columns of the hashes h, each from its bucket's table."""
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket, kind="stable")
        sorted_, got = h[order], [np.zeros(len(h)) for _ in range(k)]
        for b, i, j in _cut(bucket[order]):
            f = self._file(name, b, files)
            if f is not None:
                for o, x in zip(got, looked_up(f, sorted_[i:j], k)):
                    o[i:j] = x
        out = [np.empty(len(h)) for _ in range(k)]
        for o, x in zip(out, got):
            o[order] = x
        return out

    def _grams(self, v: np.ndarray, hot: np.ndarray, context: np.ndarray, pair: np.ndarray, whole: np.ndarray, files: dict) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Count of each trigram, four columns of each context, continuations of each pair."""
        home, nb = _range(v, self.buckets), self.buckets
        count = self._of("trigrams", np.where(hot, _range(whole, nb, 64), home), whole, 1, files)[0]
        columns, before = [np.zeros(len(v)) for _ in range(4)], np.zeros(len(v))
        for rows, prefix in ((np.flatnonzero(~hot), ""), (np.flatnonzero(hot), "hot-")):
            for h, into, name in ((context[rows], columns, "contexts"), (pair[rows], [before], "pairs")):
                bucket = _range(h, nb, 64) if prefix else home[rows]
                for o, x in zip(into, self._of(prefix + name, bucket, h, len(into), files)):
                    o[rows] = x
        return count, columns, before

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, at: np.ndarray, files: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: known tokens, base score, and log10 probability."""
        ids, place = np.unique(np.concatenate((w, [np.uint64(START)])), return_inverse=True)
        columns = self._words(ids, files)
        count, cont = (x[place[:-1]] for x in columns[:2])
        known, base = count > 0, np.log10((count + 1) / (self.tokens + (self.types + 1)))
        if not self.tokens:
            return sums(known.astype(np.int64), at), sums(base, at), sums(base, at)
        before = np.concatenate((place[-1:], place[:-2]))  # the middle word: the word before, or START
        before[at[:-1]] = place[-1]
        hot = np.isin(ids, self.hot)[before]
        context = pair_hash(u, v)
        triple, of_context, of_pair = self._grams(v, hot, context, pair_hash(v, w), pair_hash(context, w), files)
        p = np.maximum(cont - self.discounts[0][np.minimum(cont, 3).astype(np.int64)], 0) / max(self.continuations, 1) + self.word_mass / (self.types + 1)
        for n, of, d in ((of_pair, [x[before] for x in columns[2:]], self.discounts[1]), (triple, of_context, self.discounts[2])):
            rest = d[1] * of[1] + d[2] * of[2] + d[3] * of[3]
            p = np.where(of[0] > 0, (np.maximum(n - d[np.minimum(n, 3).astype(np.int64)], 0) + rest * p) / np.maximum(of[0], 1), p)
        return sums(known.astype(np.int64), at), sums(base, at), sums(np.log10(p), at)


def _discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of entries with count 1 to 4; 0.5, 1 and 1.5 where they are undefined."""
    if min(n) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0, *(float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0, k)) for k in (1, 2, 3))])


def _flushed(emit, width: int) -> object:
    """A map function that gathers the last `width` words of trigrams up to FLUSH tokens and emits rows of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for *grams, _ in sequences(b.column(0)):
                held.append(tuple(grams[3 - width :]))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield _batch(emit(*(np.concatenate(x) for x in zip(*held))))
                    held = []
        if held:
            yield _batch(emit(*(np.concatenate(x) for x in zip(*held))))

    return run


def _few(n: np.ndarray) -> list[np.ndarray]:
    """Whether a count is 1, 2, 3 or more."""
    return [x.astype(np.uint64) for x in (n == 1, n == 2, n >= 3)]


def _pair_rows(v: np.ndarray, w: np.ndarray, c: np.ndarray, nb: int) -> list[tuple[int, int, bytes]]:
    """What whole pairs with c continuations tell of their first and second words."""
    ids, total, *few = _summed(v, c.astype(np.uint64), *_few(c))
    seconds, n = _summed(w)
    return _dealt(FOLLOWED, _range(ids, nb), ids, total, *few) + _dealt(CONTINUED, _range(seconds, nb), seconds, n.astype(np.uint64))


def train(texts: DataFrame, text: str = "text", buckets: int | None = None) -> Model:
    """Count all texts; buckets: files of each table, one for each BUCKET_BYTES of text by default, so that a bucket fits a task at any size."""
    spark = texts.sparkSession
    nb = buckets or max(4, -(-(texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET_BYTES))
    shared = runtime.scratch_path(spark, "kneser-ney")
    folder = runtime.local_path(shared)
    os.makedirs(folder)
    source = texts.select(F.col(text))

    def words(w: np.ndarray) -> list[tuple[int, int, bytes]]:
        ids, n = _summed(w)
        return _dealt(COUNTS, _range(ids, nb), ids, n.astype("<u8"))

    def merge(t: pa.Table) -> pa.Table:
        got = [_load(x.as_py()) for x in t.column("payload")]
        ids, n = _summed(*(np.concatenate(x) for x in zip(*got)))
        top = np.argsort(-n.astype(np.int64), kind="stable")[: max(32, 2 * OFTEN // nb)]
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "kind": pa.array([COUNTS], pa.int32()), "payload": pa.array([_dump(ids, n)], pa.binary()), "n": pa.array([int(n.sum())], pa.int64()), "v": pa.array([len(ids)], pa.int64()), "top": pa.array([ids[top].astype(np.int64).tolist()], pa.list_(pa.int64())), "top_n": pa.array([n[top].astype(np.int64).tolist()], pa.list_(pa.int64()))})

    counted = runtime.written(source.mapInArrow(_flushed(words, 1), _ROW).groupBy("bucket").applyInArrow(merge, f"{_ROW}, n long, v long, top array<long>, top_n array<long>"), "word-counts")
    told = counted.select("n", "v", "top", "top_n").collect()  # one row for each bucket
    tokens, types = sum(r["n"] for r in told), sum(r["v"] for r in told)
    often, often_n = (np.array([x for r in told for x in r[c]], np.int64) for c in ("top", "top_n"))
    hot = np.unique(np.append(often[often_n * 4 * nb > tokens].astype(np.uint64), np.uint64(START)))  # at most 4 for each bucket
    names = spark.sparkContext.broadcast(Names(np.append(np.uint64(START), often[np.argsort(-often_n, kind="stable")][: OFTEN - 1].astype(np.uint64))))

    def grams(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[tuple[int, int, bytes]]:
        ids, place = np.unique(np.concatenate((w, [np.uint64(START)])), return_inverse=True)
        start, w = place[-1], place[:-1]
        v = np.where(v == START, start, np.concatenate(([start], w[:-1])))
        u = np.where(u == START, start, np.concatenate(([start], v[:-1])))
        h = pair_hash(pair_hash(ids[u], ids[v]), ids[w])
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n, h, order = np.diff(np.concatenate((first, [len(h)]))), h[first], order[first]
        u, v, w = u[order], v[order], w[order]
        bucket = np.where(np.isin(ids, hot)[v], _range(h, nb, 64), _range(ids, nb)[v])
        order = np.argsort(bucket * len(ids) + v)
        bucket, u, v, w, n = bucket[order], u[order], v[order], w[order], n[order].astype("<u4")
        rows, rank = [], names.value.ranks(ids)
        for b, i, j in _cut(bucket):
            starts = np.flatnonzero(np.concatenate(([True], v[i + 1 : j] != v[i : j - 1])))
            runs = np.diff(np.concatenate((starts, [j - i]))).astype("<u4")
            short = [y for x in (v[i:j][starts], u[i:j], w[i:j]) for y in (rank[x], ids[x[rank[x] == OFTEN]])]
            rows.append((b, COUNTS, _dump(*short, runs, n[i:j])))
        return rows

    def shard(t: pa.Table) -> pa.Table:
        parts = []
        for x in t.column("payload"):
            *short, runs, ns = _load(x.as_py())
            vs, us, ws = (names.value.long(*short[i : i + 2]) for i in (0, 2, 4))
            parts.append((us, np.repeat(vs, runs), ws, ns))
        u, v, w, n = (np.concatenate(x) for x in zip(*parts))
        parts = None
        context = pair_hash(u, v)
        h = pair_hash(context, w)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n, h, order = np.add.reduceat(n[order].astype(np.uint64), first), h[first], order[first]
        u, v, w, context = u[order], v[order], w[order], context[order]
        own = t.column("bucket")[0].as_py()
        _save(folder, f"trigrams-{own:06d}", *table(h, n))
        totals, h, order = [int((n == k).sum()) for k in (1, 2, 3, 4)], None, None
        often, few, rows, saved = np.isin(v, hot), _few(n), [], [1, 0, 0, 0, 0]
        for here in (np.flatnonzero(~often), np.flatnonzero(often)):
            if not len(here):
                continue
            order = here[np.argsort(context[here])]
            first = np.flatnonzero(np.concatenate(([True], context[order[1:]] != context[order[:-1]])))
            of_context = [np.add.reduceat(x[order], first) for x in (n, *few)]
            of = order[first]
            pair = pair_hash(v[here], w[here])
            order = np.argsort(pair)
            pair = pair[order]
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            c, pair, order = np.diff(np.concatenate((first, [len(pair)]))), pair[first], here[order[first]]
            if often[here[0]]:
                rows += _dealt_pairs(HOT_CONTEXTS, names.value, nb, v[of], u[of], context[of], *of_context)
                rows += _dealt_pairs(HOT_PAIRS, names.value, nb, v[order], w[order], pair, c.astype("<u8"))
                continue
            _save(folder, f"contexts-{own:06d}", *table(context[of], *of_context))
            _save(folder, f"pairs-{own:06d}", *table(pair, c))
            saved[1:3] = [1, 1]
            rows += _pair_rows(v[order], w[order], c, nb)
            totals += [int((c == k).sum()) for k in (1, 2, 3, 4)]
        rows.append((own, TOTALS, _dump(np.array(totals + [0] * (8 - len(totals)) + saved, "<u8"))))
        return pa.Table.from_batches([_batch(rows)])

    def gather(t: pa.Table) -> pa.Table:
        own, rows, totals, saved = t.column("bucket")[0].as_py(), [], [0] * 8, [0] * 5
        by = {k: [_loaded_pairs(names.value, x) for j, x in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist()) if j == k] for k in (HOT_CONTEXTS, HOT_PAIRS)}
        if by[HOT_CONTEXTS]:
            v, u, *columns = (np.concatenate(x) for x in zip(*by[HOT_CONTEXTS]))
            _save(folder, f"hot-contexts-{own:06d}", *table(*_summed(pair_hash(u, v), *columns)))
            saved[3] = 1
        if by[HOT_PAIRS]:
            v, w, c = (np.concatenate(x) for x in zip(*by[HOT_PAIRS]))
            pair = pair_hash(v, w)
            order = np.argsort(pair)
            pair = pair[order]
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            c, v, w = np.add.reduceat(c[order], first), v[order[first]], w[order[first]]
            _save(folder, f"hot-pairs-{own:06d}", *table(pair[first], c))
            saved[4] = 1
            rows = _pair_rows(v, w, c, nb)
            totals[4:] = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        return pa.Table.from_batches([_batch([*rows, (own, TOTALS, _dump(np.array(totals + saved, "<u8")))])])

    def finish(t: pa.Table) -> pa.Table:
        ids, values, of = [], [], np.zeros(13, np.int64)
        for kind, x in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist()):
            columns = _load(x)
            if kind == TOTALS:
                of += columns[0].astype(np.int64)
                continue
            full = np.zeros((6, len(columns[0])), np.uint64)
            full[{COUNTS: 0, CONTINUED: 1, FOLLOWED: 2}[kind] :][: len(columns) - 1] = columns[1:]
            ids.append(columns[0])
            values.append(full)
        cont = np.zeros(0, np.uint64)
        if ids:
            i, c, cont, total, *few = _summed(np.concatenate(ids), *np.concatenate(values, 1))
            _save(folder, f"words-{t.column('bucket')[0].as_py():06d}", i.astype("<u8"), c.astype("<u8"), cont.astype("<u4"), total.astype("<u8"), *(x.astype("<u4") for x in few))
        by = [int((cont == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"bucket": t.column("bucket").slice(0, 1).cast(pa.int32()), "saved": pa.array([[bool(ids), *(bool(x) for x in of[8:])]], pa.list_(pa.bool_())), "n": pa.array([[*by, int((cont >= 3).sum()), int(cont.sum()), *of[:8].tolist()]], pa.list_(pa.int64()))})

    kept = runtime.written(source.mapInArrow(_flushed(grams, 3), _ROW).groupBy("bucket").applyInArrow(shard, _ROW), "trigram-sums")
    of_hot = F.col("kind").isin(HOT_CONTEXTS, HOT_PAIRS)
    rest = kept.where(of_hot).groupBy("bucket").applyInArrow(gather, _ROW)
    ends = kept.where(~of_hot).unionByName(rest).unionByName(counted.select("bucket", "kind", "payload")).groupBy("bucket").applyInArrow(finish, "bucket int, saved array<boolean>, n array<long>").collect()
    n = np.array([r["n"] for r in ends] or [[0] * 14]).sum(0).tolist()
    of_words, continuations = _discounts(n[:4]), n[5]
    mass = (of_words[1] * n[0] + of_words[2] * n[1] + of_words[3] * n[4]) / max(continuations, 1)
    files = {name: frozenset(r["bucket"] for r in ends if r["saved"][i]) for i, name in enumerate(TABLES)}
    return Model(folder, nb, hot, tokens, types, [of_words, _discounts(n[10:]), _discounts(n[6:10])], continuations, files, float(mass))


def scored(documents: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", fold: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # sums and the hot ids; the arrays stay in their files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, files = shared.value, {}
        for b in batches:
            n, known, base, full = [], [], [], []
            for u, v, w, at in sequences(b.column(1)):
                k, s, p = m.score(u, v, w, at, files)
                for into, x in ((n, np.diff(at)), (known, k), (base, s), (full, p)):
                    into.append(x)
            n, known, base, full = (np.concatenate(x) if x else np.zeros(0) for x in (n, known, base, full))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(remainder(b.column(0), fold) == held), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(base), pa.array(full), pa.array(10 ** (-full / np.maximum(n, 1)))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = documents.schema[ident].dataType.simpleString()
    return documents.select(F.col(ident), F.col(text)).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def learned_and_scored(documents: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all of them."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return scored(documents, train(documents.where(F.pmod(key, F.lit(fold)) != held)), fold=fold, held=held)
