"""Words, word hashes and word shingles of whole texts, over Arrow string buffers.

A word is a maximal run of bytes outside the six ASCII white-space
characters; A-Z count as a-z. All functions work on many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one round of array operations takes; a longer text is a round of its own.
ROUND = 1 << 19
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, ROUND), U)
        out[0] = 1
        done = 1
        while done < len(out):
            k = min(done, len(out) - done)
            out[done : done + k] = out[:k] * U(pow(base, done, 1 << 64))
            done += k
        if len(out) > 4 * ROUND:
            return out  # of one very long text: not kept
        _powers[base] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rounds(offsets: np.ndarray, size: int = ROUND) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each row; ``space`` marks the bytes between words."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(space[data], out=inside[1:-1])
    edge = inside[1:] & ~inside[:-1]
    stop = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):  # a row's first byte begins a word even if the row before ends in one
        touch = cuts[inside[cuts] & inside[cuts + 1]]
        edge[touch] = True
        stop[touch] = True
    starts, ends = np.flatnonzero(edge), np.flatnonzero(stop)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lower-cased bytes of each span; spans are in order.

    Works on runs of spans of about ``ROUND`` bytes: what it holds for each byte
    of a very long text is bounded.
    """
    if not len(starts):
        return np.empty(0, U)
    out, i, n = np.empty(len(starts), U), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + ROUND, "right")))
        at, stop = int(starts[i]), int(ends[i:j].max())
        part, a, b = data[at:stop], starts[i:j] - at, ends[i:j] - at
        total = np.zeros(len(part) + 1, U)
        np.cumsum((LOWER[part].astype(U) + U(1)) * powers(BASE, len(part) + 1)[: len(part)], out=total[1:])
        out[i:j] = mix((total[b] - total[a]) * powers(INVERSE, len(part) + 1)[a] + (b - a).astype(U))
        i = j
    return out


def pieces(data: np.ndarray, size: int = ROUND) -> Iterator[np.ndarray]:
    """Cuts a very long text into runs of about ``size`` bytes that end between words."""
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + size)
        while stop < n:  # on to the next byte between words
            gap = np.flatnonzero(SPACE[data[stop : stop + size]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(n, stop + size)
        yield data[at:stop]
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words of each row."""
    if len(offsets) == 2 and len(data) > ROUND:
        words = np.concatenate([_hashes(part, np.array([0, len(part)]))[0] for part in pieces(data)])
        return words, np.array([len(words)])
    return _hashes(data, offsets)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = spans(data, offsets)
    return hash_spans(data, starts, ends), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each row, repeats included, and their number.

    A row with fewer words, but not none, has its whole sequence as one shingle.
    """
    if not len(words):
        return np.empty(0, U), np.zeros(len(counts), np.int64)
    factors = powers(0xD6E8FEB86659FD93, width + 1)
    padded = np.concatenate([words, np.zeros(width, U)])
    total = np.zeros(len(words), U)
    for k in range(width):
        total += padded[k : k + len(words)] * factors[k + 1]
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short:
        a, n = first[i], counts[i]
        total[a] = (words[a : a + n] * factors[1 : n + 1]).sum() + U(n)
    amount = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    keep = np.repeat(first - (np.cumsum(amount) - amount), amount) + np.arange(amount.sum())
    return mix(total[keep]), amount


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its number and the sorted distinct shingle hashes of its whole text."""
    data, offsets = strings(column)
    for lo, hi in rounds(offsets):
        part = offsets[lo : hi + 1]
        hashes, amount = shingle_hashes(*word_hashes(data[part[0] : part[-1]], part - part[0]), width)
        at = 0
        for i, n in enumerate(amount.tolist(), lo):
            yield i, distinct(hashes[at : at + n])
            at += n


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]
