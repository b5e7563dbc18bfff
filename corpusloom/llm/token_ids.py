"""Token ids in binary shards: texts are encoded by a public tokenizer and written as Simple-8b blobs in document order.

The files are Parquet, one row per blob: shard (in document order), ids before the blob in its shard, the documents'
ids and lengths, and the blob (see simple8b). A blob holds whole documents; it ends with the document that fills
BLOB_IDS. Spark commits the files, so a task that is run again leaves no second copy.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows with the same doc_id follow
each other by the hash of their text, then the text; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm import simple8b
from corpusloom.llm.arrays import chunks

BLOB_IDS = 1 << 19
#: Words that a worker remembers with their ids, and bytes of their texts and ids; beyond either, it starts anew.
REMEMBERED, REMEMBERED_BYTES = 900_000, 160_000_000
END_ID = 2
FILE_SCHEMA = "shard int, before long, doc_ids array<long>, sizes array<int>, blob binary"

#: The split pattern of the public vocabulary word_bpe_49k, as its file states it, and for lower-case words of
#: ASCII and Latin-1 letters, which the normaliser only lower-cases.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: White space of any script, and the separators that Python alone counts to it.
_GAP = re.compile(r"\s")


class _Known(dict):
    """Word or piece -> number, given out as they come; fresh: those not encoded yet."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, word: bytes | str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, by way of each distinct word.

    Where the tokenizer's file states the normaliser and split that no two words share (white space always parts
    them), a word's ids do not depend on its neighbours; each distinct word is encoded once. Any other tokenizer, and
    a text with the mark of a special token, goes through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split == SPLIT and told["model"].get("end_of_word_suffix") == "</w>"
        if self.by_word:
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.as_bytes = {ord(c): self.whole.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
            self.last = np.zeros(self.whole.get_vocab_size() + 1, bool)
            for token, i in self.whole.get_vocab(with_added_tokens=False).items():
                self.last[i] = token.endswith("</w>")
            self.forget()

    def forget(self) -> None:
        self.known, self.place = _Known(), _Known()
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.piece_ids, self.piece_at = self.ids, self.at
        self.text_bytes = 0

    def held(self) -> int:
        """Bytes of the remembered words and pieces and of their ids."""
        return self.text_bytes + sum(x.nbytes for x in (self.ids, self.at, self.piece_ids, self.piece_at))

    def _pieces(self, words: list[bytes]) -> list[list[str]]:
        """The split of each word, ASCII and Latin-1 letters by the pattern's form for them, others by the tokenizer, many at a time.

        Words without white space of any script are joined by blanks: the normaliser keeps each of them one word, so
        the parts of the normalised text are theirs in order. A word that holds such white space goes alone, as it
        may vanish or fall into several.
        """
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        out = [_LATIN.findall(t.lower()) if _PLAIN.fullmatch(t) else None for t in texts]
        for i, t in enumerate(texts):
            if out[i] is not None and not t.isascii():
                out[i] = [p.translate(self.as_bytes) for p in out[i]]
        rest = [i for i, x in enumerate(out) if x is None]
        normal, split = self.whole.normalizer.normalize_str, self.whole.pre_tokenizer.pre_tokenize_str
        for i in rest:
            if _GAP.search(texts[i]):
                out[i] = [x for x, _ in split(normal(texts[i]))]
        whole = [i for i in rest if out[i] is None]
        for start in range(0, len(whole), 500):
            own = whole[start : start + 500]
            text = normal(" ".join(texts[i] for i in own))
            parts = text.split(" ")
            if len(parts) != len(own):
                raise ValueError("the normaliser changed the number of words")
            for i in own:
                out[i] = []
            ends = np.cumsum([len(p) + 1 for p in parts])
            pieces = split(text)
            for (piece, _), k in zip(pieces, np.searchsorted(ends, [at[0] for _, at in pieces], "right").tolist()):
                out[own[k]].append(piece)
        return out

    def _learn(self, words: list[bytes]) -> None:
        split = self._pieces(words)
        order = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64)
        fresh, self.place.fresh = self.place.fresh, []
        if fresh:
            lines = [" ".join(fresh[i : i + 1000]) for i in range(0, len(fresh), 1000)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(fresh):
                own = [np.array(e.ids, np.uint32) for p in fresh for e in [self.bare.encode(p, add_special_tokens=False)]]
                ids, ends = np.concatenate(own), np.cumsum([len(x) for x in own])
            self.piece_at = np.concatenate((self.piece_at, self.piece_at[-1] + ends))
            self.piece_ids = np.concatenate((self.piece_ids, ids))
        self.text_bytes += sum(map(sys.getsizeof, words)) + sum(map(sys.getsizeof, fresh))
        ids, at = self.piece_ids, self.piece_at
        flat, size = _gather(ids, at, order)
        per_word = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(size)[np.cumsum(per_word) - 1] if len(order) else np.zeros(len(split), np.int64)
        ends = np.where(np.cumsum(per_word) > 0, ends, 0)
        self.at = np.concatenate((self.at, self.at[-1] + ends))
        self.ids = np.concatenate((self.ids, flat))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of each."""
        if not self.by_word or any("<|" in t for t in texts):
            own = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(own) if own else np.zeros(0, np.uint32), np.fromiter(map(len, own), np.int64, len(own))
        if len(self.known) > REMEMBERED or self.held() > REMEMBERED_BYTES:
            self.forget()
        known, found = self.known, []
        for t in texts:
            data = t.encode("utf-8", "surrogatepass")
            # only ASCII words may be lower-cased before the normaliser composes their marks
            words = data.lower().split() if data.isascii() else [w.lower() if w.isascii() else w for w in data.split()]
            found.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if known.fresh:
            self._learn(known.fresh)
            known.fresh = []
        ids, size = _gather(self.ids, self.at, np.concatenate(found)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum(size)))
        by_text = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
        return ids, np.diff(ends[by_text])


def _gather(flat: np.ndarray, at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of flat in the given order, one after another, and their sizes."""
    size = at[order + 1] - at[order]
    first = np.cumsum(size) - size
    return flat[np.repeat(at[order] - first, size) + np.arange(int(size.sum()))], size


def encoder(path: str) -> Encoder:
    """The process's encoder for a file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core; it need not start a thread for each of the machine's
    kept = sys.__dict__.setdefault("_corpusloom_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write(documents: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, blob_ids: int = BLOB_IDS) -> None:
    """Write the shard files of the documents' texts below path."""
    spark = documents.sparkSession
    parts = runtime.shuffle_partitions(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, held, ids, sizes, shard = encoder(tokenizer), 0, [], [], [], 0

        def blob() -> pa.RecordBatch:
            data = simple8b.encode(np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([data], pa.binary())], ["shard", "before", "doc_ids", "sizes", "blob"])

        for b in batches:
            shard = b.column(2)[0].as_py() if len(b) else shard
            for start, end, _, _ in chunks(b.column(1)):  # not all texts of a batch as Python objects
                flat, n = coder(b.column(1).slice(start, end - start).to_pylist())
                own = np.insert(flat, np.cumsum(n), end_id).astype(np.uint32)
                n = n + 1
                ids.append(own)
                held += b.column(0).slice(start, end - start).to_pylist()
                sizes += n.tolist()
                if sum(map(len, ids)) >= blob_ids:
                    yield blob()
                    before += sum(sizes)
                    held, ids, sizes = [], [], []
        if held:
            yield blob()

    ranged.withColumn("shard", F.spark_partition_id()).mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; each blob is decoded and checked as a whole."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    base, first = 0, {}
    for r in sorted(totals.collect()):  # a row for each shard
        first[r["shard"]] = base
        base += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, size = simple8b.decode(r["blob"]).astype("<u4"), np.array(r["sizes"], np.int64)
                ends = np.cumsum(size)
                if len(ids) != ends[-1]:
                    raise ValueError(f"shard {r['shard']}: {len(ids)} ids, {ends[-1]} listed")
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), size.tolist())]
                start = first[r["shard"]] + r["before"] + ends - size
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(size), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = simple8b.decode(r["blob"]).astype(np.int64)
                at = np.concatenate(([0], np.cumsum(r["sizes"]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], ["doc_id", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(decode, "doc_id long, ids array<long>")


def encoded(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = runtime.scratch_path(documents.sparkSession, "token-ids")
    write(documents, tokenizer, path, end_id)
    return read(documents.sparkSession, path)
