"""Word shingles as 64-bit hashes, computed for a whole Arrow batch of texts at once.

Words are maximal runs of bytes other than space and 0x09-0x0D after lower-casing A-Z. A word's hash is a
polynomial over a fixed random byte table; five word hashes are mixed into one shingle hash. All of it is
array arithmetic on the batch's byte buffer, so a task needs a few arrays of the size of one batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_RNG = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[np.arange(65, 91)] = _BYTE[np.arange(97, 123)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PLACE = _RNG.integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of one buffer; texts are separated by a space byte."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    value = _BYTE[data]
    # Bytes weigh by their place in the word: each byte is mixed with that place, then runs are summed.
    place = np.arange(len(data), dtype=np.uint64)
    first = np.zeros(len(data), np.int64)
    first[start[1:]] = np.diff(start)
    first[start[0]] = start[0]
    place -= np.cumsum(first).astype(np.uint64)
    value = (value ^ (place * _STEP)) * (value | np.uint64(1))
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value[~inside] = 0
    total = np.add.reduceat(value, start)
    return start, end, mix(total + (end - start).astype(np.uint64) * _STEP)


def _pieces(column: pa.Array):
    """Texts in runs of a few MB: index of the first text, joined bytes, offsets of the texts in them."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = pc.fill_null(column, b"")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(column):
        room = np.cumsum(sizes[first:first + 4096] + 1)
        n = max(1, int(np.searchsorted(room, _SLICE, "right")))
        yield first, b" ".join(column.slice(first, n).to_pylist()), np.concatenate(([0], room[:n]))
        first += n


def hashed(column: pa.Array):
    """For each text in order: (hashes of all its words, sorted distinct hashes of its shingles)."""
    empty = np.empty(0, np.uint64)
    for _, joined, at in _pieces(column):
        start, _, word = _words(np.frombuffer(joined, np.uint8))
        cut = np.searchsorted(start, at)
        n = len(word) - WIDTH + 1
        if n > 0:
            run = np.zeros(n, np.uint64)
            for k in range(WIDTH):
                run += mix(word[k:k + n] + _PLACE[k])* _PLACE[k]
            run = mix(run)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            words = word[a:b]
            if b - a >= WIDTH:
                yield words, np.unique(run[a:b - WIDTH + 1])
            elif b > a:
                yield words, mix(np.array([(mix(words + _PLACE[:b - a]) * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield words, empty
