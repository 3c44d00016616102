"""Static binary-fuse filters over 64-bit keys, built and probed in numpy.

A filter keeps one 16-bit fingerprint per place, about 1.13 to 1.3 places a key. A key belongs to the set
only if the fingerprints at its three places combine to its own, so a member is never missed and
another key passes with a chance of 1 in 65,536. It cannot be changed after it is built.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over key plus seed."""
    h = keys + U(seed)
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    segments: int
    prints: np.ndarray

    @staticmethod
    def layout(n: int) -> tuple[int, int]:
        """Length of a segment (a power of two) and number of segments a key's first place may lie in."""
        if n < 2:
            return 4, 1
        segment = min(1 << 18, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        space = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        return segment, max(1, int(np.ceil(space / segment)) - 2)

    @staticmethod
    def places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """The three places of each hash, in three neighbouring segments; one row per place."""
        first = ((h >> U(32)) * U(segment * segments)) >> U(32)
        mask = U(segment - 1)
        second = (first + U(segment)) ^ ((h >> U(18)) & mask)
        third = (first + U(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """The filter of a set of keys. Places with a single key are peeled off round by round; a seed that gets stuck is changed."""
        keys = np.unique(keys.astype(U))
        n = len(keys)
        segment, segments = cls.layout(n)
        size = (segments + 2) * segment
        for seed in range(1, 200):
            h = mixed(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
            at = cls.places(h, segment, segments)
            count = np.bincount(at.ravel(), minlength=size)
            which = np.zeros(size, np.int64)  # exclusive or of the numbers of the keys at a place
            for row in at:
                np.bitwise_xor.at(which, row, np.arange(n))
            rounds, left = [], n
            alone = np.flatnonzero(count == 1)
            while len(alone):
                key, first = np.unique(which[alone], return_index=True)
                rounds.append((key, alone[first]))
                left -= len(key)
                touched = at[:, key]
                for row in touched:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(which, row, key)
                touched = np.unique(touched)
                alone = touched[count[touched] == 1]
            if left == 0:
                own = (h ^ (h >> U(32))).astype(np.uint16)
                prints = np.zeros(size, np.uint16)
                for key, place in reversed(rounds):
                    a, b, c = at[:, key]
                    prints[place] = own[key] ^ prints[a] ^ prints[b] ^ prints[c]
                return cls(seed * 0x9E3779B97F4A7C15 % 2**64, segment, segments, prints)
        raise RuntimeError("no seed gave a filter")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may be in the set; true for every member."""
        h = mixed(keys.astype(U), self.seed)
        a, b, c = self.places(h, self.segment, self.segments)
        return (h ^ (h >> U(32))).astype(np.uint16) == self.prints[a] ^ self.prints[b] ^ self.prints[c]
