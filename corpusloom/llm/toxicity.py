"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, learned from document labels alone.

A sentence's probability is a logistic function of hashed features (words and word starts); a document's is
1 - prod(1 - p). Only whether the document is toxic is known in training; the gradient reaches each sentence through
the noisy-or, starting from shrunken log odds of the features. Learning takes a bounded sample of labelled rows (about TRAIN_ROWS of each label, by a hash);
scoring covers all sentences of all rows. Words are parted by white space and ASCII punctuation;
sentences end at . ! ? or a line feed.

Defined cases: a null or empty text has no sentence and score 0; rows with a null label are not learned; labels that
occur several times for an id are all learned; without a positive or without a negative row all scores are the share
of positive rows (0 without rows); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import MARKS, Words, chunks, mix, released, remainder, sums

#: Expected number of labelled rows of each label to learn from.
TRAIN_ROWS = 4000
BITS, EPOCHS, RATE, START, DECAY, BATCH = 20, 6, 0.1, -6.0, 1e-6, 64
#: Training rows that a bucket must occur in, rows added to each count of the first weights, and their share of the log odds.
LEAST_ROWS, ADDED, SHARE = 5, 3.0, 0.6
#: Word starts of so many bytes are features.
STARTS = (4, 5)


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets by word (words x kinds), n + 1 word offsets by sentence, n + 1 sentence offsets by text, words' bytes (start, end)."""
    w = Words(raw, at, MARKS)
    if not len(w):
        return np.zeros((0, 1 + len(STARTS)), np.int32), np.zeros(1, np.int64), np.zeros(len(at), np.int64), np.zeros((0, 2), np.int64)
    h, shift, row = w.hashes(), np.uint64(64 - BITS), w.texts()
    breaks = np.concatenate(([0], np.cumsum(np.isin(raw, np.frombuffer(b".!?\n", np.uint8)))))
    ends = np.ones(len(w), bool)
    ends[:-1] = (breaks[w.start[1:]] != breaks[w.end[:-1]]) | (row[1:] != row[:-1])
    first = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
    kinds = [h]
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    size = w.end - w.start
    for n in STARTS:
        part = np.zeros(len(w), np.uint64)
        for i in range(n):
            part = part * np.uint64(257) + np.where(i < size, low[np.minimum(w.start + i, len(raw) - 1)] + np.uint64(1), np.uint64(0))
        kinds.append(mix(part + np.uint64(n << 50)))
    bucket = np.stack([(k >> shift).astype(np.int32) for k in kinds], 1)
    sentence_at = np.concatenate((first, [len(w)]))
    return bucket, sentence_at, np.searchsorted(first, w.at), np.stack((w.start, w.end), 1)


def _logits(weight: np.ndarray, bias: float, bucket: np.ndarray, sentence_at: np.ndarray) -> np.ndarray:
    return sums(weight[bucket].sum(1, dtype=np.float64), sentence_at) + bias


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def _integers(column: pa.Array) -> list[np.ndarray]:
    """The rows of a binary column as writable views of one array of 32-bit integers."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view("<i4") if data is not None and data.size else np.zeros(0, "<i4")
    at = (at - at[0]) // 4
    return [whole[i:j] for i, j in zip(at[:-1], at[1:])]


def _first(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """First weights: shrunken log odds of the buckets that occur in LEAST_ROWS rows; all others stay 0 for good."""
    seen = np.zeros((2, 1 << BITS))
    for y, _, bucket in docs:
        seen[y, np.unique(bucket)] += 1
    count = [sum(d[0] == y for d in docs) for y in (0, 1)]
    odds = np.log((seen[1] + ADDED) / (count[1] + 2 * ADDED)) - np.log((seen[0] + ADDED) / (count[0] + 2 * ADDED))
    total = seen.sum(0)
    odds *= np.where(total >= LEAST_ROWS, total / (total + 10), 0)
    odds = np.where(np.abs(odds) < 1, np.where(total >= LEAST_ROWS, 1e-6, 0), odds) * SHARE
    odds[0] = 0
    return odds


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights (a fixed number of buckets) and bias from rows with a text and a label of 0 or 1."""
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = np.zeros(1 << BITS, np.float32)
    if len(totals) < 2:
        return weight, 50.0 if 1 in totals else -50.0
    share = F.when(F.col("y") == 1, min(1.0, train_rows / totals[1])).otherwise(min(1.0, train_rows / totals[0]))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(1).to_numpy()
            for start, end, raw, at in chunks(b.column(0)):
                bucket, sentence_at, text_at, _ = features(raw, at)
                ends, words = [], []
                for i in range(end - start):
                    s = sentence_at[text_at[i] : text_at[i + 1] + 1]
                    ends.append((s - s[0] if len(s) else s).astype("<i4").tobytes())
                    words.append((bucket[s[0] : s[-1]] if len(s) > 1 else bucket[:0]).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(labels[start:end].astype(np.int32)), pa.array(ends, pa.binary()), pa.array(words, pa.binary())], ["y", "s", "b"])

    chosen = rows.where((F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)) < share)
    docs = []
    for b in chosen.mapInArrow(prepare, "y int, s binary, b binary").toArrow().to_batches():  # a few large buffers, no object for each row
        labels, ends, words = b.column(0).to_pylist(), _integers(b.column(1)), _integers(b.column(2))
        docs += [(y, s, w.reshape(-1, 1 + len(STARTS))) for y, s, w in zip(labels, ends, words) if len(s) > 1]
    docs.sort(key=lambda d: (d[0], d[2].ravel()[:16].tobytes(), len(d[2])))
    weight = _first(docs)
    for _, _, bucket in docs:
        bucket[weight[bucket] == 0] = 0
    scale, bias, bias_scale = np.full(1 << BITS, 1e-2), START, 1e-2
    balance = {y: len(docs) / 2 / max(1, sum(d[0] == y for d in docs)) for y in (0, 1)}
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = draw.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            part = [docs[i] for i in order[start : start + BATCH]]
            y = np.array([d[0] for d in part])
            bucket = np.concatenate([d[2] for d in part])
            words = np.cumsum([0] + [len(d[2]) for d in part])
            sentence_at = np.concatenate([d[1][:-1] + w for d, w in zip(part, words)] + [words[-1:]])
            text_at = np.cumsum([0] + [len(d[1]) - 1 for d in part])
            z = _logits(weight, bias, bucket, sentence_at)
            p = _sigmoid(z)
            whole = -np.expm1(-sums(_softplus(z), text_at))
            pull = np.where(y == 1, 1 - 1 / np.maximum(whole, 1e-9), 1.0) * np.array([balance[v] for v in y]) / len(part)
            slope = p * np.repeat(pull, np.diff(text_at))
            touched, place = np.unique(bucket, return_inverse=True)
            by_word = np.repeat(slope, np.diff(sentence_at))
            g = np.bincount(place.ravel(), np.repeat(by_word, bucket.shape[1]), len(touched)) + DECAY * weight[touched]
            scale[touched] += g * g
            weight[touched] -= RATE * g / np.sqrt(scale[touched])
            weight[0] = 0
            step = slope.sum()
            bias_scale += step * step
            bias = min(bias - 0.05 * step / np.sqrt(bias_scale), -2.0)
    return weight.astype(np.float32), float(bias)


def score(df: DataFrame, weight: np.ndarray, bias: float, ident: str = "doc_id", text: str = "text", fold: int = 5, held: int = 0) -> DataFrame:
    """Of every row: doc_id, held_out, score, predicted, n_sentences, worst_start and worst_score of the sentence that offends most.

    worst_start is the byte in the UTF-8 text where that sentence begins, -1 where there is none.
    """
    shared = df.sparkSession.sparkContext.broadcast((weight, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in batches:
            whole, n, where, worst = [], [], [], []
            for _, _, raw, at in chunks(b.column(1)):
                bucket, sentence_at, text_at, place = features(raw, at)
                z = _logits(w, b0, bucket, sentence_at)
                whole.append(-np.expm1(-sums(_softplus(z), text_at)))
                n.append(np.diff(text_at))
                top = np.full(len(at) - 1, -1)
                if len(z):
                    row = np.repeat(np.arange(len(at) - 1), np.diff(text_at))
                    order = np.lexsort((-np.arange(len(z)), z, row))
                    top[row[order]] = order
                has = top >= 0
                worst.append(np.where(has, _sigmoid(z[top]), 0.0) if len(z) else np.zeros(len(top)))
                where.append(np.where(has, place[sentence_at[np.maximum(top, 0)], 0] - at[:-1], -1) if len(z) else np.full(len(top), -1))
            got = np.concatenate(whole) if whole else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(remainder(b.column(0), fold) == held), pa.array(np.clip(got, 0, 1)), pa.array((got >= 0.5).astype(np.int32)), *(pa.array((np.concatenate(x) if x else np.zeros(0)).astype(t)) for x, t in ((n, np.int32), (where, np.int64), (worst, np.float64)))], ["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_score"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident), F.col(text)).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences int, worst_start long, worst_score double")


def sentences(df: DataFrame, weight: np.ndarray, bias: float, least: float = 0.5, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (bytes of the UTF-8 text), sentence and score of every sentence with a score of `least` or more."""
    shared = df.sparkSession.sparkContext.broadcast((weight, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in batches:
            for first, _, raw, at in chunks(b.column(1)):
                bucket, sentence_at, text_at, place = features(raw, at)
                p = _sigmoid(_logits(w, b0, bucket, sentence_at))
                own = np.flatnonzero(p >= least)
                row = np.searchsorted(text_at, own, "right") - 1
                start, end = place[sentence_at[own], 0], place[sentence_at[own + 1] - 1, 1]
                data = raw.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + first)), pa.array(start - at[row]), pa.array(end - at[row]), pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(start, end)], pa.string()), pa.array(p[own])], ["doc_id", "start", "end", "sentence", "score"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident), F.col(text)).mapInArrow(run, f"doc_id {kind}, start long, end long, sentence string, score double")


def train(documents: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Fit on the labelled documents outside the held-out fold: the sample is drawn from the labels, so it can always be broadcast."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(F.pmod(key, F.lit(fold)) != held)
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, train_rows / max(totals.get(1, 0), 1))).otherwise(min(1.0, train_rows / max(totals.get(0, 0), 1)))
    chosen = known.where((F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)) < share)  # about 2 * train_rows rows
    return fit(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), train_rows=1 << 62)


def scored(documents: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS) -> DataFrame:
    return score(documents, *train(documents, labels, fold, held, train_rows), fold=fold, held=held)


def accepted(documents: DataFrame, weight: np.ndarray, bias: float, least: float = 0.5) -> DataFrame:
    """The documents whose score is below `least`, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast((weight, bias))
    at_text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in batches:
            keep = []
            for _, _, raw, at in chunks(b.column(at_text)):
                bucket, sentence_at, text_at, _ = features(raw, at)
                keep.append(-np.expm1(-sums(_softplus(_logits(w, b0, bucket, sentence_at)), text_at)) < least)
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(released(run), documents.schema)
