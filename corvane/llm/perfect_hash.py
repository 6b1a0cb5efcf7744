"""Minimal perfect hashing of distinct 128-bit keys, with the keys stored for verification.

Level by level each key that is left has a place of its own hash in a bitmap; it stays where it is alone, and goes on to
the next level where it isn't. A key's slot is the number of set bits before its own, so n keys have the slots 0 to n - 1.
A key that isn't one of them may meet a set bit, too; so the key stored at the slot is compared.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

#: Places for each key that is left.
ROOM = 1.6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashed(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """An independent 64-bit hash of the pairs for each level."""
    with np.errstate(over="ignore"):
        seed = np.uint64(2 * level + 1) * _ODD
        return mix((hi + seed) * _ODD + mix(lo ^ seed))


class PerfectHash:
    """hi, lo: the keys as two columns of 64 bits, distinct pairs."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        hi, lo = hi.astype(np.uint64), lo.astype(np.uint64)
        self.bits, left = [], np.arange(len(hi))
        while len(left):
            size = max(64, int(ROOM * len(left)))
            at = (hashed(hi[left], lo[left], len(self.bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left = left[~alone[at]]
        self._rank()
        self.hi, self.lo = np.zeros_like(hi), np.zeros_like(lo)
        slots = self._slots(hi, lo)
        self.hi[slots], self.lo[slots] = hi, lo

    def _rank(self) -> None:
        """Of each level, the slot of each place that is set."""
        self.before, n = [], 0
        for b in self.bits:
            rank = np.cumsum(b, dtype=np.int64) + (n - 1)
            self.before.append(rank)
            n += int(b.sum())

    def __len__(self) -> int:
        return len(self.hi)

    def _slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, left = np.full(len(hi), -1), np.arange(len(hi))
        for level, (bits, rank) in enumerate(zip(self.bits, self.before, strict=True)):
            at = (hashed(hi[left], lo[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 of those that are none of the keys."""
        hi, lo = hi.astype(np.uint64), lo.astype(np.uint64)
        out = self._slots(hi, lo)
        if len(self):
            out[(out >= 0) & ((self.hi[out] != hi) | (self.lo[out] != lo))] = -1
        return out

    def dump(self) -> dict[str, bytes]:
        sizes = np.array([len(b) for b in self.bits], np.int64)
        return {"sizes": sizes.tobytes(), "bits": b"".join(np.packbits(b).tobytes() for b in self.bits), "hi": self.hi.tobytes(), "lo": self.lo.tobytes()}

    @classmethod
    def load(cls, got: dict[str, bytes]) -> PerfectHash:
        self = cls.__new__(cls)
        self.bits, at, all_bits = [], 0, np.frombuffer(got["bits"], np.uint8)
        for n in np.frombuffer(got["sizes"], np.int64):
            self.bits.append(np.unpackbits(all_bits[at : at + -(-n // 8)])[:n].astype(bool))
            at += -(-n // 8)
        self.hi, self.lo = np.frombuffer(got["hi"], np.uint64), np.frombuffer(got["lo"], np.uint64)
        self._rank()
        return self
