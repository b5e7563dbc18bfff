"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting runs over partitions of the labelled rows, the log-probability matrix (languages x buckets, a fixed size
for a given set of languages) is broadcast, and texts are scored in batches of numpy gathers and segment sums.

Defined cases: a null text or one without a letter is `und` with score 0; a null lang is never learned; with no
labelled row at all every text is `und`; repeated rows and ids are scored one by one; of languages with equal
probability the alphabetically first wins. Columns that are not named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import mix, remainder, sums

#: Expected number of labelled rows to learn from, by language; rows are chosen by a hash of their text.
TRAIN_ROWS = 4000
#: log2 of the number of n-gram buckets, the n-gram lengths, and the added count.
BITS, ORDERS, ALPHA = 15, (1, 2, 3, 4), 0.5
#: Languages that the matrix may hold: it is broadcast, so its size has a bound (256 MB).
MOST_LANGUAGES = 2000
_CHARS = 1_000_000


def _letters() -> np.ndarray:
    """Whether each code point is a letter, made once in a process."""
    import sys

    table = getattr(sys, "_corpusloom_letters", None)
    if table is None:
        table = sys._corpusloom_letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return table


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHARS:
            yield start, i + 1, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts), texts[start:]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts' letters and single gaps, n + 1 offsets by text, letters by text."""
    low = [" " + (t or "").lower() + " " for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), size)
    letter = _letters()[code]
    count = np.bincount(row[letter], minlength=len(low))
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()  # gaps shrink to one blank; none spans two texts
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    if len(keep):
        keep[0] = True
    code, row = code[keep].astype(np.uint64), row[keep]
    found, rows = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(code):
            break
        end = len(code) - n + 1
        h = h[:end] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in ORDERS:
            whole = row[:end] == row[n - 1 :]
            if n == 1:
                whole &= code != 32
            found.append((mix(h[whole] + np.uint64(n << 56)) >> np.uint64(64 - BITS)).astype(np.int32))
            rows.append(row[:end][whole])
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), count
    both, bucket = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(both, kind="stable")
    return bucket[order], np.searchsorted(both[order], np.arange(len(texts) + 1)), count


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their float32 log-probability matrix (languages + 1 prior column) from rows with text and lang.

    A bounded sample serves: about `train_rows` rows of each language, those whose text hash falls below a share.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    totals = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(totals)
    if not names:
        return [], np.zeros((0, (1 << BITS) + 1), np.float32)
    place = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, end, run in _runs(texts):
                bucket, at, _ = grams(run)
                own = np.fromiter((place[x] for x in langs[start:end]), np.int64, end - start)
                for k in np.unique(own):
                    here = np.repeat(own == k, np.diff(at))
                    total[k] = total.get(k, 0) + np.bincount(bucket[here], minlength=1 << BITS)
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], ["k", "b", "n"])

    share = F.create_map(*(x for n in names for x in (F.lit(n), F.lit(min(1.0, train_rows / totals[n])))))
    chosen = rows.where((F.pmod(F.xxhash64("t", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)) < F.element_at(share, F.col("l")))
    counts = np.zeros((len(names), 1 << BITS))
    for r in chosen.mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r.column(0).to_numpy(), r.column(1).to_numpy()] = r.column(2).to_numpy()
    matrix = np.log(counts + ALPHA) - np.log(counts.sum(1, keepdims=True) + ALPHA * (1 << BITS))
    n = np.array([totals[x] for x in names], float)
    return names, np.hstack([matrix, np.log(n / n.sum())[:, None]]).astype(np.float32)


def predict(df: DataFrame, names: list[str], matrix: np.ndarray, ident: str = "doc_id", text: str = "text", fold: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the predicted language) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        gram, prior = table[:-1], table[-1]
        for b in batches:
            texts, got, sure = b.column(1).to_pylist(), [], []
            for _, _, run in _runs(texts):
                bucket, at, letters = grams(run)
                if not names:
                    got += ["und"] * len(run)
                    sure.append(np.zeros(len(run)))
                    continue
                joint = np.stack([sums(gram[bucket, k].astype(np.float64), at) for k in range(len(names))], 1) + prior
                best = joint.argmax(1)
                none = letters == 0
                sure.append(np.where(none, 0.0, 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)))
                got += ["und" if x else names[k] for x, k in zip(none, best)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(remainder(b.column(0), fold) == held), pa.array(got, pa.string()), pa.array(np.concatenate(sure) if sure else np.zeros(0))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident), F.col(text)).mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, fold: int = 4, held: int = 2, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all of them."""
    known = documents.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(fold)) != held)
    return predict(documents, *learn(known, train_rows=train_rows), fold=fold, held=held)
