"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

Texts lie end to end in one byte array. A word is a run of bytes that are not white
space; A-Z may be lower-cased. A word's hash is a polynomial in an odd base modulo
2**64, taken as a difference of prefix sums, so no loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Text that is worked on at a time; a worker's arrays take some fifty times as much.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up, cls.down


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text is a range of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    value = np.arange(1, 257, dtype=np.uint16)
    if lower:
        value[ord("A") : ord("Z") + 1] += 32
    return gap, value


_GAP, _LOWERED = _tables(True)
_, _PLAIN = _tables(False)


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n + 1 offsets: text i has words[o[i]:o[i + 1]]."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)  # a gap after each text
    ends = ends + np.arange(1, len(texts) + 1)
    gap = _GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((_LOWERED if lower else _PLAIN)[data].astype(U64) * up[: len(data)], out=sums[1:])
    hashed = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64))
    return hashed, np.concatenate(([0], np.searchsorted(starts, ends)))


def shingles(hashed: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `width` words and their n + 1 offsets, repeats included.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate(([0], np.cumsum(made)))
    # place of each shingle's first word, and how many words it has
    first = np.repeat(offsets[:-1] - out_offsets[:-1], made) + np.arange(out_offsets[-1])
    out = np.zeros(len(first), U64)
    long = np.repeat(counts >= width, made)
    size = np.repeat(np.minimum(counts, width), made)
    for j in range(width):
        factor = U64(pow(_BASE, 2 * j + 3, 1 << 64))
        at = np.minimum(first + j, max(len(hashed) - 1, 0))
        term = hashed[at] * factor if len(hashed) else out
        out += np.where(long | (size > j), term, U64(0))
    return mix(out + size.astype(U64)), out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and their n + 1 offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(offsets)))
