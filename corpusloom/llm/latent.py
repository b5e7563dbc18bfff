"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents. 2. The benchmark's passages become TF-IDF
rows, of which a randomised SVD (random range, power iterations, small eigenproblem; every product with the rows is a
map over partitions whose partial sums are added by a shuffle) gives a latent space. Each group of about GROUP passages
has a space of its own, of as many dimensions as keep RETAINED of the norm of each of its passages. 3. Every
document is cut into blocks of BLOCK words; windows of 4 and of 8 blocks at every second block, and for passages of up
to SHORT words also windows of 1 and 2 blocks at every block, in which the benchmark's
vocabulary has enough of the weight to reach COSINE at all, are folded into the space and compared with all passages: the dot product of the latent vectors over the window's full TF-IDF norm
and the passage's latent norm, a cosine that unrelated words keep low. 4. Windows of COSINE or more, and places
where RUN words of an item stand in a row (foreign words beside them do not matter then; the cosine is 0), are read word for
word: the longest common subsequence with the item, weighted by IDF, must reach LCS of the item, and short of EXACT
also ANSWER of the weight of the item's answer must stand near it. The answer is the benchmark's `answer` column, else
the last sentence, else the last third of the words.

Words in more than STOP of the documents have no weight in the latent space, and LEAST_WEIGHT or more when words are
read. An item of fewer than RUN words is found where all of its words stand in a row. Words are runs of bytes other than white space and ASCII punctuation, A-Z lower-cased. The benchmark's matrices are
broadcast in blocks of about MOST_PASSAGES passages, one search over the documents for each block.

Defined cases: null and empty texts and items match nothing, nor do items without words; null ids
are carried as they are; repeated rows are found each, repeated items once each; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm.arrays import MARKS, Words, chunks, sums

BITS, EXTRA, POWER = 17, 16, 2
BLOCK, ITEM_WORDS, RUN, SHORT = 8, 64, 6, 24
COSINE, LCS, EXACT, ANSWER, STOP, LEAST_WEIGHT = 0.45, 0.55, 0.9, 0.5, 0.5, 0.1
MOST_PASSAGES, GROUP, RETAINED = 4096, 192, 0.98


def _buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    w = Words(raw, at, MARKS)
    return (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64), w.at, w


def _added(rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Sums of rows (part int, data binary of float64) by part."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<f8") for x in t.column("data"))
        return pa.table({"part": t.column("part").slice(0, 1).cast(pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    return [(r["part"], np.frombuffer(r["data"], "<f8")) for r in rows.groupBy("part").applyInArrow(add, "part int, data binary").collect()]


def frequencies(documents: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents with each bucket."""
    step = 1 << 13

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(1 << BITS)
        for b in batches:
            n += len(b)
            for start, end, raw, at in chunks(b.column(0)):
                bucket, own, _ = _buckets(raw, at)
                row = np.repeat(np.arange(end - start), np.diff(own))
                total += np.bincount(np.unique(row * (1 << BITS) + bucket) & ((1 << BITS) - 1), minlength=1 << BITS)
        parts = [(-1, np.array([n], float))] + [(i, total[i : i + step]) for i in range(0, 1 << BITS, step)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([d.tobytes() for _, d in parts], pa.binary())], ["part", "data"])

    got, total = dict(_added(documents.select("text").mapInArrow(count, "part int, data binary"))), np.zeros(1 << BITS)
    for i, part in got.items():
        if i >= 0:
            total[i : i + step] = part
    return int(got[-1][0]) if got else 0, total


def passages(benchmark: DataFrame) -> DataFrame:
    """item, start, features (words' buckets) of runs of up to ITEM_WORDS words, each starting half a run after the one before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, words = [], [], []
            for start, end, raw, at in chunks(b.column(1)):
                bucket, own, _ = _buckets(raw, at)
                for i in range(end - start):
                    n = int(own[i + 1] - own[i])
                    if n < RUN:
                        continue
                    for s in range(0, max(1, n - ITEM_WORDS // 2), ITEM_WORDS // 2):
                        ids.append(start + i)
                        starts.append(s)
                        words.append(bucket[own[i] + s : min(own[i] + s + ITEM_WORDS, own[i + 1])].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int32()), pa.array(words, pa.binary())], ["item_id", "start", "words"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, start int, words binary")


def _rows(words: list[bytes], place: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, value and n + 1 offsets of unit TF-IDF rows."""
    columns, values, size = [], [], [0]
    for w in words:
        bucket, n = np.unique(np.frombuffer(w, "<i4"), return_counts=True)
        bucket, n = bucket[place[bucket] >= 0], n[place[bucket] >= 0]
        v = n * idf[bucket]
        columns.append(place[bucket])
        values.append(v / max(np.sqrt((v * v).sum()), 1e-12))
        size.append(len(bucket))
    return np.concatenate(columns or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0)]), np.cumsum(size)


def svd(rows: DataFrame, place: np.ndarray, idf: np.ndarray, n_columns: int, rank: int) -> np.ndarray:
    """Right singular vectors (columns x rank, orthonormal) of the TF-IDF rows: randomised, with every product distributed."""
    sc, step = rows.sparkSession.sparkContext, 4096
    size = min(rank + EXTRA, n_columns)

    def product(basis: np.ndarray, gram: bool) -> np.ndarray:
        """A'(A basis), or (A basis)'(A basis)."""
        shared = sc.broadcast((basis.astype(np.float64), place, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, where, weight = shared.value
            out = np.zeros((q.shape[1] if gram else n_columns, q.shape[1]))
            for b in batches:
                column, value, at = _rows(b.column(0).to_pylist(), where, weight)
                y = sums(q[column] * value[:, None], at)
                if gram:
                    out += y.T @ y
                else:
                    np.add.at(out, column, value[:, None] * np.repeat(y, np.diff(at), axis=0))
            for i in range(0, len(out), step):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out[i : i + step].tobytes()], pa.binary())], ["part", "data"])

        total = np.zeros((q_size if gram else n_columns, q_size)) if (q_size := basis.shape[1]) else basis
        for i, part in _added(rows.select("words").mapInArrow(run, "part int, data binary")):
            block = part.reshape(-1, q_size)
            total[i : i + len(block)] = block
        return total

    q = np.linalg.qr(np.random.default_rng(1).standard_normal((n_columns, size)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(product(q, False))[0]
    values, vectors = np.linalg.eigh(product(q, True))
    keep = np.argsort(-values)[: min(rank, int((values > 1e-9).sum()))]
    return q @ vectors[:, keep]


def runs(h: np.ndarray, text_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and hashes of the runs of so many words that lie in one text."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text_of[:n] == text_of[size - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
    return at, out


def common(item: np.ndarray, region: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence; weight: of each of the item's words."""
    best = np.zeros(len(region) + 1)
    for word, w in zip(item, weight):
        here = best.copy()
        here[1:] = np.maximum(here[1:], np.where(region == word, best[:-1] + w, 0))
        best = np.maximum.accumulate(here)
    return float(best[-1])


def _answer(raw: bytes, given: str | None) -> np.ndarray:
    """Word hashes of the answer."""
    text = (given or "").encode() or raw
    if not given:
        ends = [i for i, c in enumerate(text[:-1]) if c in b".!?\n" and text[i + 1 :].strip(b".!?\n ")]
        if ends:
            text = text[ends[-1] + 1 :]
        else:
            words = text.split()
            text = b" ".join(words[-max(1, len(words) // 3) :])
    data = np.frombuffer(text, np.uint8)
    return Words(data, np.array([0, len(data)]), MARKS).hashes()


def leaks(documents: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER) -> DataFrame:
    """doc_id, item_id, start, end (words of the document), cosine, lcs, answer: the best window of each document and item found."""
    spark = documents.sparkSession
    n_docs, seen = frequencies(documents)
    idf = np.where(seen <= max(STOP * n_docs, 1), np.log((n_docs + 1) / (seen + 1)) + 0.1, 0.0)
    rows = runtime.written(passages(benchmark), "benchmark-passages")
    doc_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((documents, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, start int, end int, cosine double, lcs double, answer double"
    count = rows.count()
    has_answer = "answer" in benchmark.columns
    items = benchmark.select("item_id", "text", *(["answer"] if has_answer else [])).where("text is not null").distinct()
    blocks = max(1, -(-max(count, items.count()) // MOST_PASSAGES))
    found = None
    for block in range(blocks):
        own = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block
        groups = max(1, -(-rows.where(own).count() // GROUP))
        spaces = []
        for group in range(groups):
            mine = rows.where(own & (F.pmod(F.xxhash64("item_id", "start", F.lit(1)), F.lit(groups)) == group))
            space = latent_space(mine, idf)
            spaces += [space] if space else []
        searched = _search(documents, spaces, items.where(own).toArrow(), idf, cosine, lcs, answer, schema)
        found = searched if found is None else found.unionByName(searched)
    best = F.max_by(F.struct("start", "end", "cosine", "lcs", "answer"), F.struct("lcs", "cosine", -F.col("start"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def latent_space(rows: DataFrame, idf: np.ndarray, retained: float = RETAINED) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray] | None:
    """Passages, their unit latent vectors, basis, and column of each bucket (-1: none); None if no word has weight.

    The rank is the least that keeps so large a share of the norm of each passage.
    """
    part = rows.distinct().toArrow()  # about GROUP passages
    words = part.column("words").to_pylist()
    used = np.zeros(1 << BITS, bool)
    used[np.frombuffer(b"".join(words), "<i4")] = True
    used &= idf > 0
    if not used.any():
        return None
    place = np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)
    basis = svd(rows, place, idf, int(used.sum()), len(words))
    column, value, at = _rows(words, place, idf)
    latent = sums(basis[column] * value[:, None], at)
    kept = np.cumsum(latent**2, 1)[(at[1:] > at[:-1])].min(0)
    rank = min(int(np.searchsorted(kept, retained * retained)) + 1, len(kept))
    latent, basis = latent[:, :rank], basis[:, :rank]
    return part, latent / np.maximum(np.sqrt((latent**2).sum(1, keepdims=True)), 1e-9), basis, place


def _search(documents: DataFrame, spaces: list[tuple], texts: pa.Table, idf: np.ndarray, cosine: float, lcs: float, answer: float, schema: str) -> DataFrame:
    names = texts.column("item_id").to_pylist()
    known: dict = {}
    for i, x in enumerate(names):
        known.setdefault(x, []).append(i)
    words, answers = [], []
    given = texts.column("answer").to_pylist() if "answer" in texts.column_names else [None] * len(names)
    for t, a in zip(texts.column("text").to_pylist(), given):
        data = np.frombuffer(t.encode(), np.uint8)
        words.append(Words(data, np.array([0, len(data)]), MARKS).hashes())
        answers.append(_answer(t.encode(), a))
    sent = [(latent.astype(np.float32), (basis * idf[np.flatnonzero(place >= 0)][:, None]).astype(np.float32), place, [known[x] for x in part.column("item_id").to_pylist()], np.array([len(x) // 4 for x in part.column("words").to_pylist()])) for part, latent, basis, place in spaces]
    shared = documents.sparkSession.sparkContext.broadcast((sent, idf.astype(np.float32), names, words, answers))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, idf, names, words, answers = shared.value
        floor = np.maximum(idf, LEAST_WEIGHT)
        weights = [floor[(w >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.float64) for w in words]
        answer_weights = [floor[(w >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.float64) for w in answers]
        anchors: dict[int, list] = {}  # run length -> (hash, item, place) of the items' runs
        for i, w in enumerate(words):
            if len(w):
                where, key = runs(w, np.zeros(len(w), np.int64), size := min(RUN, len(w)))
                anchors.setdefault(size, []).append((key, np.full(len(key), i), where))
        for size, parts in anchors.items():
            key, item, where = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            anchors[size] = key[order], item[order], where[order]
        pairs, answer_pairs = ([list(zip(x.tolist(), w.tolist())) for x, w in zip(y, z)] for y, z in ((words, weights), (answers, answer_weights)))
        for b in batches:
            out: list[tuple] = []
            for first, _, raw, at in chunks(b.column(1)):
                hashes = Words(raw, at, MARKS)
                text_at, h = hashes.at, hashes.hashes()
                if not len(h):
                    continue
                bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
                n = np.diff(text_at)
                text_of = hashes.texts()
                for size, (key, item_of, where) in anchors.items():
                    spots, run = runs(h, text_of, size)
                    low = np.searchsorted(key, run)
                    hit = np.flatnonzero(key[np.minimum(low, len(key) - 1)] == run)
                    low, spots = low[hit], spots[hit]
                    many = np.searchsorted(key, run[hit], "right") - low
                    entry = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    spots = np.repeat(spots, many)
                    places = np.unique(np.stack((text_of[spots], item_of[entry], spots - where[entry]), 1), axis=0)  # a copy's runs are one place
                    for text, item, place_of in places.tolist():
                        n_item = len(words[item])
                        slack = 0 if n_item < RUN else n_item
                        out.append((int(first + text), item, int(max(text_at[text], place_of - slack)), int(min(text_at[text + 1], place_of + n_item + slack)), 0.0, int(text_at[text]), h))
                blocks = -(-n // BLOCK)
                block_text = np.repeat(np.arange(len(n)), blocks)
                order = np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                starts = text_at[block_text] + order * BLOCK
                block_at = np.concatenate((starts, [len(h)]))
                weight = idf[bucket]
                norm = sums(weight * weight, block_at)
                for latent, scaled, place, owners, lengths in sent:
                    own = place[bucket]
                    known = sums(np.where(own >= 0, weight * weight, 0), block_at)
                    windows, wanted = [], np.zeros(len(norm) + 1, bool)
                    short = np.flatnonzero(lengths <= SHORT)
                    for wide in (1, 2, 4, 8) if len(short) else (4, 8):
                        size, inside = norm.copy(), known.copy()
                        for k in range(1, wide):
                            same = np.flatnonzero(block_text[k:] == block_text[:-k]) if len(norm) > k else np.zeros(0, np.int64)
                            size[same] += norm[same + k]
                            inside[same] += known[same + k]
                        open_ = np.flatnonzero((inside >= cosine * cosine * size) & (inside > 0) & ((wide < 4) | (order % 2 == 0)))
                        windows.append((wide, open_, np.sqrt(size[open_])))
                        for k in range(wide):
                            wanted[np.minimum(open_ + k, len(norm))] = True
                    wanted = wanted[:-1]
                    tokens = np.flatnonzero((own >= 0) & np.repeat(wanted, np.diff(block_at)))
                    at_wanted = np.concatenate((np.flatnonzero(wanted), [len(norm)]))
                    vectors = sums(scaled[own[tokens]], np.searchsorted(tokens, block_at[at_wanted]))
                    row_of = np.cumsum(wanted) - 1
                    for wide, open_, size in windows:
                        for s in range(0, len(open_), 8192):
                            rows = open_[s : s + 8192]
                            z = vectors[row_of[rows]]
                            for k in range(1, wide):
                                there = np.flatnonzero(block_text[np.minimum(rows + k, len(norm) - 1)] == block_text[rows])
                                there = there[rows[there] + k < len(norm)]
                                z[there] += vectors[row_of[rows[there] + k]]
                            mine = short if wide < 4 else np.arange(len(latent))
                            sim = (z @ latent[mine].T) / size[s : s + 8192, None]
                            for i, p in zip(*np.nonzero(sim >= cosine)):
                                block, text = rows[i], block_text[rows[i]]
                                for item in owners[mine[p]]:
                                    n_item = len(words[item])
                                    out.append((int(first + text), item, int(max(text_at[text], starts[block] - n_item)), int(min(text_at[text + 1], starts[block] + BLOCK * wide + n_item)), float(sim[i, p]), int(text_at[text]), h))
            yield from checked(b, out, names, words, weights, answer_weights, pairs, answer_pairs)

    def checked(b: pa.RecordBatch, out: list[tuple], names: list, words: list, weights: list, answer_weights: list, pairs: list, answer_pairs: list) -> Iterator[pa.RecordBatch]:
        good: dict[tuple[int, int], tuple] = {}
        merged: list[list] = []
        for x in sorted(out, key=lambda x: x[:4]):  # regions of one document and item that overlap are read as one
            if merged and merged[-1][:2] == [x[0], x[1]] and x[2] <= merged[-1][3] and merged[-1][6] is x[6]:
                merged[-1][3:5] = [max(merged[-1][3], x[3]), max(merged[-1][4], x[4])]
            else:
                merged.append(list(x))
        for row, item, start, end, sim, text_start, h in merged:
            region, total = h[start:end], max(float(weights[item].sum()), 1e-9)
            there = set(region.tolist())
            if sum(w for x, w in pairs[item] if x in there) < lcs * total:
                continue
            share = common(words[item], region, weights[item]) / total
            of = float(answer_weights[item].sum())
            told = sum(w for x, w in answer_pairs[item] if x in there) / of if of > 0 else 1.0
            if share >= lcs and (share >= EXACT or told >= answer) and share > good.get((row, item), (0, 0, 0, 0))[3]:
                good[row, item] = (start - text_start, end - text_start, sim, share, told)
        keys = sorted(good)
        values = [good[k] for k in keys]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        items = pa.array([names[k[1]] for k in keys], texts.schema.field("item_id").type)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k[0] for k in keys], pa.int64())), items, *(pa.array([v[i] for v in values], t) for i, t in enumerate(kinds))], ["doc_id", "item_id", "start", "end", "cosine", "lcs", "answer"])

    return documents.select("doc_id", "text").mapInArrow(search, schema)


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found; rows with a null doc_id stay."""
    bad = runtime.written(leaks(documents, benchmark).select("doc_id").distinct(), "leaks")
    return documents.join(runtime.sized(bad), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
