"""Words of Arrow text batches as 64-bit hashes, by whole-array arithmetic instead of a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0] if len(off) else np.zeros(1, np.int64)


def slices(data: np.ndarray, off: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of about `size` bytes; a longer text is a run of its own."""
    first, n = 0, len(off) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): of the words of some texts in order, ASCII letters as lower case; how many each text has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    inside = ~_SPACE[data]
    edge = off[:-1][off[:-1] < n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    return hashes, np.diff(np.searchsorted(start, off)).astype(np.int64)


_MULT = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(16)]


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of runs of k words in each text, repeats included; a shorter text with words has one, of them all."""
    n = len(hashes)
    ends = np.cumsum(counts)
    begins = ends - counts
    out = np.zeros(n, np.uint64)
    width = max(n - k + 1, 0)
    for j in range(k):
        out[:width] += hashes[j : j + width] * np.uint64(_MULT[j])
    doc = np.repeat(np.arange(len(counts)), counts)
    valid = np.arange(n) + k <= ends[doc] if n else np.zeros(0, bool)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        b, c = begins[d], counts[d]
        out[b] = np.uint64(sum(int(h) * _MULT[j] for j, h in enumerate(hashes[b : b + c])) & (2**64 - 1)) + np.uint64(c)
        valid[b] = True
    return mix(out[valid]), np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
