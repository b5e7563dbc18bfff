"""Exact and near deduplication of question-answer rows; an explicit order column stands for the order of arrival."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.functions.text import normalised

# Shingle length, permutations, bands, prime, and 109 of 128 equal places (0.85 or more).
SHINGLE, PERMUTATIONS, BANDS, PRIME, SEED, LEAST_EQUAL = 5, 128, 32, (1 << 31) - 1, 42, 109
#: Shingles that a task remembers with their hashes, and characters that it takes at once.
REMEMBERED, RUN_CHARS = 500_000, 1_000_000
#: Rows of a key that meet in a task, rows of tasks that are compared together, bits of a place by which rows are told apart first.
BLOCK, SMALL, PLANES = 8192, 32, 4


def hashes(question: Column, answer: Column) -> tuple[Column, Column]:
    """(hash of the normalised question, hash of question and answer); null counts as ""."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    return F.md5(normalised(q)), F.md5(F.concat(q, F.lit("|||"), a))


def repeats(hashed: DataFrame, seq: str, key: str, pair: str) -> DataFrame:
    """seq, dup_reason of the rows of a written table that repeat an earlier question.

    The first row of each key comes from a partial aggregate, not a window, and keys that many rows share are
    broadcast (runtime.spread_join), so a question that a third of the rows share is no task of its own.
    """
    first = F.min(F.struct(F.col(seq).alias("s"), F.col(pair).alias("p"))).alias("first_row")
    firsts = runtime.written(hashed.groupBy(key).agg(first, F.count("*").alias("n")).where("n > 1"), "first-rows")
    joined = runtime.spread_join(hashed, firsts, [key]).where(F.col("first_row.s") != F.col(seq))
    return joined.select(seq, F.when(F.col("first_row.p") == F.col(pair), "duplicate_qa").otherwise("duplicate_question").alias("dup_reason"))


def exact_reasons(rows: DataFrame, question: str = "question", answer: str = "answer", seq: str = "seq") -> DataFrame:
    """rows with dup_reason: null for the first row of each normalised question, else duplicate_qa if question and
    answer are the first row's, else duplicate_question.

    seq is unique. Two questions whose texts with the answer coincide around the separator are not told apart.
    """
    key, pair = hashes(F.col(question), F.col(answer))
    hashed = runtime.written(rows.select(F.col(seq), key.alias("question_hash"), pair.alias("pair_hash")), "question-hashes")
    return rows.join(repeats(hashed, seq, "question_hash", "pair_hash"), seq, "left").select(*(F.col(f"`{c}`") for c in rows.columns), "dup_reason")


def first_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the smallest seq."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(key).agg(F.min_by(whole, F.col(seq)).alias("r")).select("r.*")


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of the permutations, drawn in turn from the seeded generator."""
    draw = random.Random(SEED)
    drawn = [(draw.randint(1, PRIME), draw.randint(0, PRIME)) for _ in range(PERMUTATIONS)]
    return np.array([a for a, _ in drawn], np.int64), np.array([b for _, b in drawn], np.int64)


class Hashed(dict):
    """Shingle -> its hash: 31 bits of MD5, so that SQL has them too. Shingles are few against their occurrences."""

    def __missing__(self, gram: str) -> int:
        from hashlib import md5

        if len(self) >= REMEMBERED:
            self.clear()
        self[gram] = h = int.from_bytes(md5(gram.encode("utf-8", "surrogatepass")).digest()[:4], "big") & 0x7FFFFFFF
        return h


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, shingle) of each distinct shingle of each text, in the order of texts, as numbers; and the distinct shingles of all.

    A window of code points is one integer, of the places of its characters in the alphabet of these texts; only the
    distinct ones are made strings.
    """
    joined, sizes = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    if len(joined) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    alphabet, one = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    one, n = one.astype(np.int64), len(alphabet)
    key = one[: len(one) - SHINGLE + 1]
    for i in range(1, SHINGLE):
        if n > (1 << 62) // (len(alphabet) ** 2):  # many characters: the windows so far are numbered anew
            seen, key = np.unique(key, return_inverse=True)
            key, n = key.astype(np.int64), len(seen)
        key, n = key * len(alphabet) + one[i : i + len(key)], n * len(alphabet)
    ends = np.cumsum(sizes)
    found = [np.unique(key[start:end], return_index=True) for start, end in zip((ends - sizes).tolist(), (ends - SHINGLE + 1).tolist()) if end > start]
    own = [i for i, size in enumerate(sizes.tolist()) if size >= SHINGLE]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    places = np.concatenate([index + (ends[i] - sizes[i]) for i, (_, index) in zip(own, found)])
    _, first, gram = np.unique(np.concatenate([k for k, _ in found]), return_index=True, return_inverse=True)
    return np.repeat(own, [len(k) for k, _ in found]), gram, [joined[i : i + SHINGLE] for i in places[first].tolist()]


def permuted(hashed: np.ndarray) -> np.ndarray:
    """hashes x PERMUTATIONS: each permutation of each hash."""
    a, b = permutations()
    out = np.empty((len(hashed), PERMUTATIONS), np.uint32)
    for start in range(0, len(hashed), 512):
        x = hashed[start : start + 512, None] * a
        x += b
        for _ in range(2):  # the remainder by 2**31 - 1, of which both steps leave a multiple out
            high = x >> 31
            x &= PRIME
            x += high
        x[x == PRIME] = 0
        out[start : start + 512] = x
    return out


def minima(text: np.ndarray, gram: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """n x PERMUTATIONS: the least of each permutation over a text's shingles (texts ascend); 0 where a text has none.

    Each distinct shingle is permuted once, however many texts have it.
    """
    out, table = np.zeros((n, PERMUTATIONS), np.int64), permuted(hashed)
    ends = np.cumsum(np.bincount(text, minlength=n)).tolist()
    for i, (start, end) in enumerate(zip([0, *ends], ends)):
        for at in range(start, end, 4096):
            least = table[gram[at : min(at + 4096, end)]].min(0)
            out[i] = least if at == start else np.minimum(out[i], least)
    return out


def signatures(rows: DataFrame, text: str, seq: str = "seq") -> DataFrame:
    """seq, n_shingles, signature; texts of fewer than five characters have 128 zeros.

    Texts are taken in runs of about RUN_CHARS characters; MD5 is called once for each distinct shingle of a run that was
    not met before, all else is vectorised.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashed()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < RUN_CHARS and i + 1 < len(texts):
                    continue
                of, gram, grams = shingles(texts[start : i + 1])
                n = i + 1 - start
                out = minima(of, gram, np.fromiter((known[g] for g in grams), np.int64, len(grams)), n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PERMUTATIONS), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(np.bincount(of, minlength=n), pa.int32()), lists], ["seq", "n_shingles", "signature"])
                start, size = i + 1, 0

    ready = rows.select(F.col(seq).cast("long").alias("seq"), normalised(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return ready.mapInArrow(run, "seq long, n_shingles int, signature array<long>")


def buckets(signed: DataFrame) -> DataFrame:
    """seq, band, key: one row for each band of each signature."""
    width = PERMUTATIONS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.slice("signature", b * width + 1, width).alias("key")))
    return signed.select("seq", F.explode(bands).alias("b")).select("seq", "b.band", "b.key")


#: A class of equal signatures, by 128 bits of hash: signatures themselves are not shuffled to be grouped.
CLASS = ["h1", "h2"]


def _class() -> list[Column]:
    return [F.xxhash64("signature").alias("h1"), F.xxhash64(F.lit(1), "signature").alias("h2")]


def _bits(signed: DataFrame, planes: int) -> DataFrame:
    """signed with bits in place of signature: its lowest bit of each place, then the second lowest, to `planes` of them.

    Places that differ in any of these bits differ, so bits tell how many places are equal at most; 32 planes tell it exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("signature")
            values = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(b), PERMUTATIONS).view(np.uint32)
            packed = np.concatenate([np.packbits((values >> np.uint32(p) & np.uint32(1)).astype(np.uint8), axis=1) for p in range(planes)], axis=1)
            width = packed.shape[1]
            column = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.arange(len(b) + 1, dtype=np.int32) * width), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), column], [*(n for n in b.schema.names if n != "signature"), "bits"])

    others = [f for f in signed.schema.fields if f.name != "signature"]
    ready = signed.select(*(f.name for f in others), F.col("signature").cast("array<int>").alias("signature"))
    return ready.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "bits binary"]))


def _key_array() -> Column:
    """Hashes of PERMUTATIONS - LEAST_EQUAL + 1 groups of places.

    Two signatures with LEAST_EQUAL equal places differ in fewer places than there are groups, so at least one group is
    equal as a whole. Such signatures share bands too (at most 19 of the 32 can differ), so nothing is added or lost
    against bands, and longer keys bring far fewer rows together.
    """
    groups = PERMUTATIONS - LEAST_EQUAL + 1
    cuts = [PERMUTATIONS * g // groups for g in range(groups + 1)]
    return F.array(*(F.xxhash64(F.lit(g), F.slice("signature", a + 1, b - a)) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))))


def _near(ours: np.ndarray, theirs: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, equal places at most) of the pairs of rows ours[x], theirs[y] with LEAST_EQUAL or more."""
    apart = np.zeros((len(x), 2), np.uint64)
    for p in range(0, ours.shape[1], 2):
        apart |= ours[x, p : p + 2] ^ theirs[y, p : p + 2]
        n = np.bitwise_count(apart).sum(1, dtype=np.int32)
        good = n <= PERMUTATIONS - LEAST_EQUAL
        if not good.all():
            x, y, apart, n = x[good], y[good], apart[good], n[good]
    return x, y, PERMUTATIONS - n


def later_matches(asked: np.ndarray, seqs: np.ndarray, wanted: np.ndarray, bits: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in asked, place in seqs, equal places at most) of matches with a larger seq, in parts; if first, one for each
    asked row at most. asked and seqs fall."""
    open_, start, step = np.arange(len(asked)), 0, 64
    while start < len(seqs) and len(open_) and seqs[start] > asked[open_[-1]]:
        theirs, later, met = bits[start : start + step], seqs[start : start + step], []
        for at in range(0, len(open_), 64):
            rows = open_[at : at + 64]
            if later[0] <= asked[rows[-1]]:
                continue
            apart = np.bitwise_count(wanted[rows, None, 0] ^ theirs[None, :, 0])
            apart += np.bitwise_count(wanted[rows, None, 1] ^ theirs[None, :, 1])
            i, j = np.nonzero((apart <= PERMUTATIONS - LEAST_EQUAL) & (later[None, :] > asked[rows, None]))
            i, j, n = _near(wanted, theirs, rows[i], j)
            if first:
                i, own = np.unique(i, return_index=True)
                j, n = j[own], n[own]
                met.append(i)
            yield i, j + start, n
        if met:
            open_ = np.setdiff1d(open_, np.concatenate(met), assume_unique=True)
        start, step = start + step, min(step * 4, 1024)


def matches(task: np.ndarray, side: np.ndarray, seq: np.ndarray, bits: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place of a later row, equal places at most) of the matches in whole tasks, in parts; rows lie by task, falling seq.

    Small tasks, nearly all there are, are compared together: each row with the row before it, then the one before that.
    """
    starts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    sizes = np.diff(np.r_[starts, len(task)])
    place = np.arange(len(task)) - np.repeat(starts, sizes)
    rows = np.flatnonzero(np.repeat(sizes <= SMALL, sizes) & (place > 0) & (side != 2))
    for back in range(1, SMALL):
        rows = rows[place[rows] >= back]
        if not len(rows):
            break
        x = rows[(side[rows - back] != 1) & (seq[rows - back] > seq[rows])]
        x, y, n = _near(bits, bits, x, x - back)
        yield x, y, n
        if first:
            rows = np.setdiff1d(rows, x, assume_unique=True)
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = np.arange(start, start + size)
        a, b = own[side[own] != 2], own[side[own] != 1]
        for x, y, n in later_matches(seq[a], seq[b], bits[a], bits[b], first):
            yield a[x], b[y], n


def _met(dealt: DataFrame, first: bool, output: str) -> DataFrame:
    """Of dealt (task, side, seq, bits): side 1 asks, 2 answers, 3 does both.

    output "pairs": j, i, n_equal of rows that ask and later rows of their task that answer and may match; "rows": the
    task, side and seq of both.
    """

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, side, seq = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
        parts = []
        for column in (b.column(3) for b in held):
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            parts.append(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1))
        bits = np.ascontiguousarray(np.concatenate(parts)).view(np.uint64)
        hit = np.zeros((2, len(task)), bool)
        for x, y, n in matches(task, side, seq, bits, first):
            if output == "rows":
                hit[0, x] = hit[1, y] = True
            elif len(x):
                yield pa.RecordBatch.from_arrays([pa.array(seq[x]), pa.array(seq[y]), pa.array(n.astype(np.int32))], ["j", "i", "n_equal"])
        if output == "rows":
            both = (hit[0] + 2 * hit[1]).astype(np.int32)
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(task[at]), pa.array(both[at]), pa.array(seq[at])], ["task", "side", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            task = b.column(0).to_numpy()
            last = int(np.searchsorted(task, task[-1]))  # where the batch's last task begins, which may go on
            if held and (last or held[-1].column(0)[-1].as_py() != task[0]):
                yield from made([*held, b.slice(0, last)] if last else held)
                held = []
            elif last:
                yield from made([b.slice(0, last)])
            held.append(b.slice(last))
        if held:
            yield from made(held)

    parts = runtime.shuffle_partitions(dealt.sparkSession)
    rows = dealt.select("task", "side", "seq", "bits").repartition(parts, "task").sortWithinPartitions("task", F.desc("seq"))
    return rows.mapInArrow(run, "task long, side int, seq long" if output == "rows" else "j long, i long, n_equal int")


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """task, side, seq, bits of rows (key, seq, asks, bits): a key is a task, or one for each two of its blocks of about
    BLOCK rows where sizes (key, n) names it: those of more than BLOCK rows."""
    named = runtime.sized(sizes)
    one = rows.join(named, "key", "left_anti").select(F.col("key").alias("task"), F.when(F.col("asks"), 3).otherwise(2).alias("side"), "seq", "bits")
    many = rows.join(named, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("seq"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = F.when(F.col("asks"), F.struct(F.xxhash64("key", "own", "other").alias("task"), F.when(F.col("own") == F.col("other"), 3).otherwise(1).alias("side")))
    answering = F.when(~F.col("asks") | (F.col("own") != F.col("other")), F.struct(F.xxhash64("key", "other", "own").alias("task"), F.lit(2).alias("side")))
    many = many.select(F.explode(F.array(asking, answering)).alias("t"), "seq", "bits").where("t is not null")
    return one.unionByName(many.select("t.task", "t.side", "seq", "bits"))


def _candidates(own: DataFrame, sizes: DataFrame, first: bool) -> DataFrame:
    """j, i, n_equal of representatives that share a key and, by PLANES bits of a place, may match; n_equal at most."""
    keyed = own.select(F.explode("keys").alias("key"), "seq", F.lit(True).alias("asks"), "bits")
    return _met(_dealt(keyed, sizes), first, "pairs")


def _sizes(own: DataFrame) -> DataFrame:
    """key, n of the keys of more than BLOCK rows."""
    return runtime.written(own.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "key-sizes")


def _verified(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """j, i, n_equal of the pairs of a written table whose whole signatures match."""
    ids = pairs.select(F.col("j").alias("seq")).unionByName(pairs.select(F.col("i").alias("seq"))).distinct()
    ids = runtime.written(ids, "pair-rows")
    whole = signed.select("seq", F.col("signature").cast("array<int>").alias("signature")).join(runtime.sized(ids), "seq", "left_semi")
    both = pairs.select("j", "i").join(whole.select(F.col("seq").alias("j"), F.col("signature").alias("a")), "j").join(whole.select(F.col("seq").alias("i"), F.col("signature").alias("b")), "i")
    equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda same: same))
    return both.select("j", "i", equal.alias("n_equal")).where(F.col("n_equal") >= LEAST_EQUAL)


def near_classes(signed: DataFrame) -> DataFrame:
    """seq, last: the last row with the same signature."""
    hashed = runtime.written(signed.select("seq", *_class()), "signature-hashes")
    last = runtime.written(hashed.groupBy(*CLASS).agg(F.max("seq").alias("last"), F.count("*").alias("n")), "signature-classes")
    return runtime.spread_join(hashed, last, CLASS).select("seq", "last")


def representatives(signed: DataFrame) -> DataFrame:
    """seq, keys, bits: the last row of each signature, its keys and PLANES bits of each place."""
    rows = _bits(signed.select("seq", *_class(), _key_array().alias("keys"), "signature"), PLANES)
    last = rows.groupBy(*CLASS).agg(F.max("seq").alias("seq"), F.max_by(F.struct("keys", "bits"), "seq").alias("r"))
    return runtime.written(last.select("seq", "r.keys", "r.bits"), "representatives")


def near_pairs(signed: DataFrame) -> DataFrame:
    """i, j (i > j), n_equal: the representatives of two signatures with 109 places or more in common."""
    own = representatives(signed)
    found = runtime.written(_candidates(own, _sizes(own), False).select("j", "i").distinct(), "near-candidates")
    return _verified(found, signed).select("i", "j", "n_equal")


def near_dropped(signed: DataFrame) -> DataFrame:
    """seq of every row of a written table with a later near duplicate.

    All but the last row of each signature go, and only that one is compared with other signatures (a later match of
    any of them is a match of the last). One later match is enough: rows meet by their keys with a few bits of each
    place only, and of what may match a row, the best is held against its whole signature. Rows whose best fails (few:
    what a few bits let through is a match or nearly one) meet all that may match them once more, with whole signatures.
    """
    own = representatives(signed)
    sizes = _sizes(own)
    copies = signed.select("seq").join(own.select("seq"), "seq", "left_anti")
    best = _candidates(own, sizes, True).groupBy("j").agg(F.max_by("i", F.struct("n_equal", "i")).alias("i"))
    best = runtime.written(best, "near-candidates")
    found = runtime.written(_verified(best, signed).select(F.col("j").alias("seq")), "near-found")
    rest = runtime.written(best.select(F.col("j").alias("seq")).join(found, "seq", "left_anti"), "near-rest")
    return copies.unionByName(found).unionByName(_whole_matches(rest, own, sizes, signed))


def _whole_matches(rest: DataFrame, own: DataFrame, sizes: DataFrame, signed: DataFrame) -> DataFrame:
    """seq of the rows of rest with a later match: whole signatures go to a task only for rows that its few bits leave."""
    asked = runtime.sized(rest)
    keys = runtime.written(own.join(asked, "seq", "left_semi").select(F.explode("keys").alias("key")).distinct(), "rest-keys")
    keyed = own.join(asked.withColumn("asks", F.lit(True)), "seq", "left").select(F.explode("keys").alias("key"), "seq", F.coalesce("asks", F.lit(False)).alias("asks"), "bits")
    few = keyed.join(runtime.sized(keys), "key", "left_semi")
    left = runtime.written(_met(_dealt(few, sizes), False, "rows"), "rest-rows")
    whole = signed.select("seq", "signature").join(runtime.sized(left.select("seq").distinct()), "seq", "left_semi")
    return _met(left.join(_bits(whole, 32), "seq"), True, "pairs").select(F.col("j").alias("seq")).distinct()


def near_deduplicated(rows: DataFrame, text: str, seq: str = "seq") -> DataFrame:
    """rows without those that have a later near duplicate."""
    gone = near_dropped(runtime.written(signatures(rows, text, seq), "signatures")).withColumnRenamed("seq", seq)
    return rows.join(gone, seq, "left_anti")
