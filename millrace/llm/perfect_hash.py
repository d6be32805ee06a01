"""Minimal perfect hash over 64-bit keys, built and probed in numpy.

Levels of bit arrays: at each level the keys that are left hash into 2 bits a key; a key that falls
alone sets its bit and leaves. A key's slot is the number of bits set before its own. A fingerprint
kept by slot tells foreign keys from own ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finaliser of key + seed steps."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def marks(keys: np.ndarray) -> np.ndarray:
    """The 32-bit fingerprints."""
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


@dataclass
class PerfectHash:
    levels: list[np.ndarray]  # bool
    before: list[np.ndarray]  # bits set before each position, over all levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct, as uint64."""
        left, levels = keys, []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, int(GAMMA * len(left)))
            at = (mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls.of(levels)

    @classmethod
    def of(cls, levels: list[np.ndarray]) -> PerfectHash:
        before, total = [], 0
        for bits in levels:
            ranks = np.cumsum(bits) - bits + total
            before.append(ranks)
            total += int(bits.sum())
        return cls(levels, before)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if no level has it (a foreign key may also get a slot: compare fingerprints)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[left], k + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[k][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *(len(b) for b in self.levels)], "<u4").tobytes()
        return head + b"".join(np.packbits(b, bitorder="little").tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<u4", n, 4).tolist(), 4 + 4 * n, []
        for size in sizes:
            step = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, step, at), count=size, bitorder="little").astype(bool))
            at += step
        return cls.of(levels)
