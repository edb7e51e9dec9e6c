"""Words and shingles of whole batches of texts as 64-bit hashes, on numpy arrays.

Texts stay UTF-8 bytes. A word's hash sums a mixed value per byte times a power of its place, a
shingle's the hashes of its words times a factor per place; both are mixed at the end. Equality of
shingles is equality of these hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
STEP = U(0xBF58476D1CE4E5B9)
LAST = U(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of a published 64-bit generator: every bit depends on all bits."""
    x = (x ^ (x >> U(30))) * STEP
    x = (x ^ (x >> U(27))) * LAST
    return x ^ (x >> U(31))


IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE_VALUE = mix64((LOWER + 1).astype(np.uint64) * ODD)
PLACE_FACTOR = mix64(np.arange(1, 65, dtype=np.uint64) * ODD) | U(1)


def powers(n: int) -> np.ndarray:
    steps = np.full(n, ODD, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def text_parts(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, bounds, first row) of runs of texts with about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    count = len(column)
    if not count:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + count + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        end = int(np.searchsorted(bounds, bounds[first] + size, side="left"))
        end = min(max(end, first + 1), count)
        part = bounds[first : end + 1]
        yield raw[part[0] : part[-1]], part - part[0], first
        first = end


def ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begins - (ends - lengths), lengths)


def hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each bound."""
    hashes, places, begin, size = [], [], 0, len(data)
    blank = IS_BLANK[data]
    cuts = np.zeros(size + 1, dtype=bool)
    cuts[bounds] = True
    while begin < size:
        end = min(begin + BLOCK, size)
        if end < size:  # cut between words; a longer word is taken whole
            free = np.flatnonzero(blank[begin:end] | cuts[begin + 1 : end + 1])
            if len(free):
                end = begin + int(free[-1]) + 1
            else:
                later = np.flatnonzero(blank[end:] | cuts[end + 1 :])
                end = end + int(later[0]) + 1 if len(later) else size
        solid = ~blank[begin:end]
        start = solid.copy()
        start[1:] &= ~solid[:-1] | cuts[begin + 1 : end]
        at = np.flatnonzero(start)
        if len(at):
            lengths = np.diff(np.append(at, end - begin))
            inside = np.arange(at[0], end - begin) - np.repeat(at, lengths)
            value = BYTE_VALUE[data[begin + at[0] : end]] * powers(int(lengths.max()))[inside]
            value[~solid[at[0] :]] = 0
            hashes.append(mix64(np.add.reduceat(value, at - at[0])))
            places.append(at + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)


def shingle_parts(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of every text of a column, in order: (values, bounds) of runs of texts.

    A text's values are sorted. A text with fewer words than ``width`` is one shingle.
    """
    for data, bounds, _ in text_parts(column):
        words, before = hash_words(data, bounds)
        yield distinct_shingles(words, before, width)


def distinct_shingles(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(before)
    windows = max(0, len(words) - width + 1)
    total = words[:windows] * PLACE_FACTOR[0]
    for j in range(1, width):
        total += words[j : windows + j] * PLACE_FACTOR[j]
    total = mix64(total + U(width))
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    found = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for a, n, size, end in zip(before[:-1].tolist(), counts.tolist(), sizes.tolist(), ends.tolist(), strict=True):
        if n >= width:
            found[end - size : end] = np.sort(total[a : a + size])
        elif n:
            found[end - 1 : end] = mix64((words[a : a + n] * PLACE_FACTOR[:n]).sum(keepdims=True) + U(n))
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = found[1:] != found[:-1]
    begins = ends - sizes
    fresh[begins[sizes > 0]] = True
    kept = np.append(0, np.cumsum(fresh))
    return found[fresh], kept[np.append(begins, len(found))]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds, 0 of nothing."""
    sums = np.zeros(len(bounds) - 1, dtype=values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        sums[full] = np.add.reduceat(values, bounds[full])
    return sums


def signatures(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set, as two columns of signed numbers."""
    one = segment_sums(mix64(found ^ ODD), bounds).view(np.int64)
    return one, segment_sums(mix64(found + STEP), bounds).view(np.int64)
