"""Hashed word shingles of Arrow text batches, with numpy over the bytes.

Words are runs outside a set of separator bytes, after lower-casing A-Z. A word's hash is
a polynomial of its bytes modulo 2^64, taken from running sums for all words of a block at
once; a shingle's hash mixes those of its words. Blocks hold about BLOCK bytes or one
document, and long documents are hashed piece by piece, cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
#: An odd base and mixing constants.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE^i and BASE^-i modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, BLOCK + 1)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


POWERS = Powers()


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """data: lower-cased bytes. Hashes of the words between starts and ends."""
    POWERS.reach(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * POWERS.down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive documents, and each document's first word (one more at the end)."""
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32)).astype(np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = np.empty(len(data), dtype=bool)
    if len(data):
        begins[0] = True
        begins[1:] = ~word[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins &= word
    stops = np.ones(len(data), dtype=bool)
    if len(data):
        stops[:-1] = ~word[1:]
        inner = offsets[1:-1]
        stops[inner[inner > 0] - 1] = True
    stops &= word
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        hashes[at:to] = piece_hashes(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)
        at = to
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text (no nulls) its sorted distinct shingle hashes; fewer words than size: one."""
    offsets, data = text_buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        to = min(to, len(texts))
        words, first = word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        n = max(len(words) - size + 1, 0)
        rolled = np.full(n, size, dtype=np.uint64)
        for place in range(size):
            rolled += words[place : place + n] * np.uint64(PLACES[place])
        rolled = mixed(rolled)
        for doc in range(to - at):
            a, b = first[doc], first[doc + 1]
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                placed = words[a:b] * np.array(PLACES[: b - a], dtype=np.uint64)
                yield mixed(placed.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.empty(0, dtype=np.uint64)
        at = to


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]
