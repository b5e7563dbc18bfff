"""Simple-8b word-aligned coding of unsigned integers, in blocks of 128 values, coded and decoded by numpy.

A coded 64-bit word holds a 4-bit selector (top bits) and up to 60 values of equal width. Selector 15 is the escape:
the next word is one raw 64-bit value. A blob is: magic, block size, number of values, number of blocks, the word
offset of every block and of the end, then the words (little-endian); a block can be read without those before it.
"""

from __future__ import annotations

import numpy as np

MAGIC, BLOCK, ESCAPE = b"S8B1", 128, 15
#: Values in a word for selectors 0 to 13; each is 60 // count bits wide.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
_TAKES = np.ones(16, np.int64)
_TAKES[: len(COUNTS)] = COUNTS


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length, 1 at least."""
    high = (v >> np.uint64(32)).astype(np.uint32)
    low = (v & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    length = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp(low.astype(np.float64))[1])
    return np.maximum(length, 1).astype(np.uint8)


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = np.zeros((blocks, BLOCK + 60), np.uint8)
    bits[:, :BLOCK] = _bits(flat).reshape(blocks, BLOCK)
    widest = bits[:, :BLOCK].copy()
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    selector = {int(c): s for s, c in enumerate(COUNTS)}
    for k in range(1, 61):
        if k > 1:
            np.maximum(widest, bits[:, k - 1 : k - 1 + BLOCK], out=widest)
        if k in selector:
            choice[widest <= WIDTHS[selector[k]]] = selector[k]
    rows, places, selectors, steps = [], [], [], []
    row, place, step = np.arange(blocks), np.zeros(blocks, np.int64), 0
    while len(row):
        s = choice[row, place]
        rows.append(row)
        places.append(place)
        selectors.append(s)
        steps.append(np.full(len(row), step))
        place = place + _TAKES[s]
        on = place < BLOCK
        row, place, step = row[on], place[on], step + 1
    if rows:
        row, place, s = np.concatenate(rows), np.concatenate(places), np.concatenate(selectors)
        order = np.lexsort((np.concatenate(steps), row))
        row, place, s = row[order], place[order], s[order]
    else:
        row = place = np.zeros(0, np.int64)
        s = np.zeros(0, np.uint8)
    width = 1 + (s == ESCAPE)
    at = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for k in range(len(COUNTS)):
        own = np.flatnonzero(s == k)
        if len(own):
            taken = padded[row[own, None], place[own, None] + np.arange(COUNTS[k])] << (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
            words[at[own]] = np.bitwise_or.reduce(taken, axis=1) | np.uint64(k << 60)
    own = np.flatnonzero(s == ESCAPE)
    words[at[own]] = np.uint64(ESCAPE << 60)
    words[at[own] + 1] = padded[row[own], place[own]]
    offsets = np.zeros(blocks + 1, np.uint32)
    offsets[1:] = np.cumsum(np.bincount(row, width, blocks)) if blocks else 0
    head = MAGIC + np.array([BLOCK], "<u4").tobytes() + np.array([n], "<u8").tobytes() + np.array([blocks], "<u4").tobytes() + offsets.astype("<u4").tobytes()
    return head + b"\0" * (-len(head) % 8) + words.astype("<u8").tobytes()


def decode(blob: bytes) -> np.ndarray:
    if blob[:4] != MAGIC:
        raise ValueError("not a Simple-8b blob")
    n, blocks = int(np.frombuffer(blob, "<u8", 1, 8)[0]), int(np.frombuffer(blob, "<u4", 1, 16)[0])
    offsets = np.frombuffer(blob, "<u4", blocks + 1, 20).astype(np.int64)
    head = 20 + 4 * (blocks + 1)
    words = np.frombuffer(blob, "<u8", -1, head + -head % 8)
    s = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(s == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    takes = np.where(raw, 0, _TAKES[s])
    end = np.cumsum(takes)
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    before = np.concatenate(([0], end))
    place = end - takes - before[offsets[:-1]][block]
    out = np.zeros((blocks, BLOCK + 60), np.uint64)
    for k in range(len(COUNTS)):
        own = np.flatnonzero((s == k) & ~raw)
        if len(own):
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            out[block[own, None], place[own, None] + np.arange(COUNTS[k])] = (words[own, None] >> (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)) & mask
    own = np.flatnonzero((s == ESCAPE) & ~raw)
    out[block[own], place[own]] = words[own + 1]
    return out[:, :BLOCK].reshape(-1)[:n]
