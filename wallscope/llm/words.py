"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

#: Words are runs of other bytes than blank, tab, line feed, vertical tab, form feed and carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240117))
BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z count as a-z.
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _random.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """One hash per word of texts that lie end to end, and the number of words of each text."""
    inside = ~SPACE[flat]
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    heads = offsets[:-1][offsets[:-1] < len(flat)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    if not len(starts):
        return np.empty(0, np.uint64), counts
    used = np.flatnonzero(inside)
    first = np.searchsorted(used, starts)
    lengths = np.diff(np.r_[first, len(used)])
    place = np.arange(len(used)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64))
        sums = np.add.reduceat(table[flat[used]] * powers[place], first)
        return mix(sums + lengths.astype(np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words (a shorter text: of all its words), and their number per text."""
    with np.errstate(over="ignore"):
        shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        ends, starts = np.cumsum(shingles), np.cumsum(counts) - counts
        total = int(shingles.sum())
        row = np.repeat(np.arange(len(counts)), shingles)
        at = starts[row] + np.arange(total) - (ends - shingles)[row]
        span = np.minimum(counts, width)[row]
        out = span.astype(np.uint64) * STEP
        for j in range(width):
            here = span > j
            out[here] += words[at[here] + j] * PLACE[j]
        return mix(out), shingles
