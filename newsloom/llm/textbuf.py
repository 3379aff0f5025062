"""Words of a batch of texts as arrays of 64-bit hashes, without a Python object per word.

Texts arrive as an Arrow array, whose bytes lie in one buffer. A word's hash is that of
its bytes: the difference of two prefix sums of byte * BASE^position, taken back to
position 0 with the inverse power (BASE is odd, so it has one modulo 2^64), then mixed.
Work goes piece by piece, so that memory beyond the hashes doesn't grow with the batch;
a piece is at least a whole word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 19
M1, M2, M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        y = x >> U(30)
        y ^= x
        y *= M1
        z = y >> U(27)
        y ^= z
        y *= M2
        z = y >> U(31)
        y ^= z
    return y


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null as empty) and the offsets of each, the end included."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and for each text the offset of its first, the end included."""
    data, offsets = buffers(texts)
    return hash_bytes(data, offsets, lower)


def hash_bytes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = [np.zeros(0, U)], np.zeros(len(offsets), np.int64)
    begin, n, words = 0, len(data), 0
    while begin < n:
        end = cut(data, begin, n)
        piece = LOWER[data[begin:end]] if lower else data[begin:end]
        starts, ends = bounds(piece, offsets, begin, end)
        hashes.append(span_hashes(piece, starts, ends))
        i, j = np.searchsorted(offsets, [begin, end])
        first[i:j] = words + np.searchsorted(starts, offsets[i:j] - begin)
        begin, words = end, words + len(starts)
    first[offsets == n] = words
    return np.concatenate(hashes), first


def cut(data: np.ndarray, begin: int, n: int) -> int:
    """Where the piece ends: after a space, or with the data; a word longer than a piece makes it longer."""
    size = PIECE
    while begin + size < n:
        spaces = np.flatnonzero(IS_SPACE[data[begin + size // 2 : begin + size]])
        if len(spaces):
            return begin + size // 2 + int(spaces[-1]) + 1
        size *= 2
    return n


def bounds(piece: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a piece; a text's start parts words too."""
    is_word = ~IS_SPACE[piece]
    breaks = np.zeros(len(piece) + 1, dtype=bool)
    breaks[[0, -1]] = True
    inner = offsets[np.searchsorted(offsets, begin, "left") : np.searchsorted(offsets, end, "right")] - begin
    breaks[inner] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | breaks[1:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | breaks[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of piece[start:end] for each pair."""
    size = 1 << max(19, int(len(piece)).bit_length())
    power, inverse = powers(size)
    sums = np.empty(len(piece) + 1, dtype=U)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((piece.astype(U) + U(1)) * power[: len(piece)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * M3)


def grams(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words within each text, and the offsets by text.

    A text with fewer words has one run of all it has, or none if it is empty.
    """
    counts = np.diff(offsets)
    lengths = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(lengths)])
    total = int(out_offsets[-1])
    if not total:
        return np.zeros(0, U), out_offsets
    place = np.arange(total) - np.repeat(out_offsets[:-1], lengths) + np.repeat(offsets[:-1], lengths)
    padded = np.concatenate([hashes, np.zeros(size, U)])
    last = np.repeat(offsets[1:], lengths)
    acc = np.zeros(total, U)
    with np.errstate(over="ignore"):
        for k in range(size):
            at = place + k
            acc = mix(acc * M3 + np.where(at < last, padded[at], U(k + 1)) + U(k))
    return acc, out_offsets


def batches_of(batches, rows: int = 2048, size: int = 4 << 20, column: str = "text"):
    """Record batches cut to at most ``rows`` rows and about ``size`` bytes of text each."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(lengths):
            continue
        group = np.maximum((np.cumsum(lengths) - lengths) // size, np.arange(len(lengths)) // rows)
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)
