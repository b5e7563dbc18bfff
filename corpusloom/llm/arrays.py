"""Vectorised text primitives: words, hashes and segments of Arrow string columns, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are taken through numpy at a time; one longer text is taken alone.
CHUNK_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
MARKS = _SPACE.copy()
MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), wrapping."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int = 0) -> np.ndarray:
    """n odd 64-bit multipliers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTE_WEIGHTS = multipliers(256)


def weights(n: int) -> np.ndarray:
    return _BYTE_WEIGHTS[:n] if n <= len(_BYTE_WEIGHTS) else multipliers(n)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes each."""
    raw, at = strings(column)
    n, start = len(at) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield start, end, raw[at[start] : at[end]], at[start : end + 1] - at[start]
        start = end


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a run of texts: start and end byte of each, and n + 1 word offsets by text.

    gaps: the bytes that part words, white space if not given.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, gaps: np.ndarray = _SPACE):
        inside = ~gaps[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[at[:-1][at[:-1] < len(raw)]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        self.raw, self.inside = raw, inside
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.at = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word after lower-casing A-Z."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        terms = (_LOWER[self.raw[self.inside]].astype(np.uint64) + np.uint64(1)) * weights(int(size.max()))[place]
        return mix(np.add.reduceat(terms, first) + size.astype(np.uint64))

    def texts(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each segment [at[i], at[i + 1]); 0 for empty ones."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out


def remainder(ids: pa.Array, by: int) -> np.ndarray:
    """crc32 of each id as text, mod `by`; a null id counts as the empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) % by for x in ids.to_pylist()), np.int64, len(ids))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives free memory back to the system when a task ends: it stays, idle beside the JVM, for later ones."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return whole
