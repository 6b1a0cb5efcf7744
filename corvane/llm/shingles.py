"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xBF58476D1CE4E5B9], dtype=np.uint64)


class Words(dict):
    """Hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[5]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, known: Words, size: int = 5) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence if it is shorter; none without words. With repeats, in order."""
    got = words(text)
    if not got:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, got), np.uint64, len(got))
    if len(h) < size:
        h, size = np.concatenate([h, np.full(1, len(h), np.uint64)]), len(h) + 1
    out = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        out += h[j : len(h) - size + 1 + j] * _ODD[j]
    return mix(out)
