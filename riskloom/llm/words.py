"""Words and word shingles of whole texts as 64-bit hashes, computed a batch at a time with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multiplier of the polynomial over word hashes (any odd number serves).
STEP = 0x9E3779B97F4A7C15
KEPT = 250_000


class WordHashes(dict):
    """word -> 64-bit hash, kept for the most recent words of a worker."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP and its inverse modulo 2**64, to the powers 0 .. n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, by in enumerate((STEP, pow(STEP, -1, 1 << 64))):
            out = np.full(size, by, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words: (n - k + 1) values from prefix sums of a polynomial modulo 2**64."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[:n], out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[: n - k + 1])


def shingle_set(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """Distinct hashes, in order, of the ``k``-word shingles; fewer words form one shingle, none forms none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(runs(h, min(k, len(words))))
