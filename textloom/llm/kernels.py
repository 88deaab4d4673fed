"""Array kernels over Arrow strings: word hashes, shingles, distinct sets. No Spark in here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier; its powers modulo 2**64 weigh the bytes of a word.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: About so many bytes of text are worked on at once (a longer text is one piece).
PIECE = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        step = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, offsets) for runs of rows of about PIECE bytes; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, word bounds by row). Words end at white space and at
    the end of a row; with ``letters_only`` also at every ASCII sign that is no letter or digit."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
    if letters_only:
        inside = ((low - np.uint8(97)) < 26) | ((low - np.uint8(48)) < 10) | (low >= 128)
    else:
        inside = ~((low == 32) | ((low - np.uint8(9)) < 5))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    hashes = (total[ends + 1] - total[starts]) * powers(INVERSE, n)[starts]
    return mix(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k-word shingle at each word, shingle bounds by row). A row of 1 to k-1 words has
    its whole sequence as the only shingle; a row without words has none."""
    n, counts = len(words), np.diff(bounds)
    rolled = np.full(n, k, np.uint64)
    for i in range(k):
        part = np.zeros(n, np.uint64)
        part[: max(n - i, 0)] = words[i:]
        rolled = mix(rolled + part)
    own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.cumsum(own)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1] - (ends - own), own)
    out = rolled[at]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        short = np.full(1, counts[row], np.uint64)
        for w in words[bounds[row] : bounds[row + 1]]:
            short = mix(short + w)
        out[ends[row] - 1] = short[0]
    return out, np.concatenate([[0], ends])


def distinct_sets(texts: pa.Array, k: int, letters_only: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (row, sorted distinct shingle hashes) for every row."""
    for first, data, offsets in pieces(texts):
        hashes, bounds = shingle_hashes(*word_hashes(data, offsets, letters_only), k)
        for row in range(len(offsets) - 1):
            yield first + row, np.unique(hashes[bounds[row] : bounds[row + 1]])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the long values that Spark stores."""
    return x.view(np.int64)


class Tally:
    """Counts of 64-bit values, given out in sorted runs of bounded size."""

    def __init__(self, flush: int = 2_000_000):
        self.flush, self.held, self.n = flush, [], 0

    def add(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append(values)
        self.n += len(values)
        if self.n >= self.flush:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.n:
            yield np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.n = [], 0
