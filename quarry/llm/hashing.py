"""Hashes of byte ranges and words, for whole slices of texts at once."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    held = _POWERS.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, "u8")
        held[0] = 1
        _POWERS[name] = held = np.cumprod(held, dtype="u8")
    return held[:n]


class Ranges:
    """Hashes of any byte range of `data`, in constant time each, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        base = (_ODD + 2 * seed * 0x1234567) & ((1 << 64) - 1) | 1
        n = len(data)
        self.back = _powers(f"-{seed}", pow(base, -1, 1 << 64), n + 1)
        values = (_TABLE if not seed else mix(_TABLE + np.uint64(seed)))[data] * _powers(f"+{seed}", base, n + 1)[:n]
        self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(values, dtype="u8")])

    def of(self, starts, ends) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + np.asarray(ends - starts, "u8") * np.uint64(0x632BE59BD9B4E019))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, "u8")


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without white space) of lower-cased texts, and the number of words up to the end of each text."""
    data = LOWER[data]
    space = SPACE[data]
    before = np.concatenate([[True], space[:-1]]) if len(data) else np.zeros(0, bool)
    begins = np.append(before, False)
    begins[at] = True
    begins = begins[:-1] & ~space
    starts = np.flatnonzero(begins)
    ends_at = np.append(space, True)
    ends_at[at] = True
    stops = np.flatnonzero(ends_at)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    return Ranges(data).of(starts, ends), np.searchsorted(starts, at[1:])


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of all runs of k words, ascending; of the whole sequence if it is shorter; none without words."""
    n = len(word)
    if not n:
        return np.zeros(0, "u8")
    k = min(k, n)
    h = np.full(n - k + 1, k, "u8")
    for i in range(k):
        h = mix(h * np.uint64(_ODD) + word[i : n - k + 1 + i])
    return np.unique(h)
