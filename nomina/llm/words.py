"""Hashes of the words of many texts and of stretches of words.

A word is a run of bytes other than the six ASCII spaces. Its hash is the XXH3 of
its bytes under a seed, made once for each different word of a run of texts; a
stretch of words hashes as a polynomial in theirs modulo 2**64, mixed, out of
prefix sums. Equal words have equal hashes; what follows from equal hashes has to
be held against the words.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64


class _Base:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            for side, base in (("up", self.base), ("down", self.back)):
                made = np.full(1 << max(16, (n - 1).bit_length()), base, _U)
                made[0] = 1
                setattr(self, side, np.multiply.accumulate(made))
        return self.up[:n], self.down[:n]


WORD_BASE = _Base(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def sums_of(values: np.ndarray, base: _Base) -> np.ndarray:
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * base.powers(len(values))[0], out=out[1:])
    return out


def between(sums: np.ndarray, base: _Base, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from ``start`` to ``end`` of what was summed."""
    return _mix((sums[end] - sums[start]) * base.powers(len(sums))[1][start])


class _Hashes(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


def word_hashes(texts: list[bytes | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of some texts, and the text it is in."""
    known = _Hashes(seed)
    parts = [np.array([known[w] for w in t.split()] if t else [], _U) for t in texts]
    return np.concatenate([np.empty(0, _U), *parts]), np.repeat(np.arange(len(texts)), [len(p) for p in parts])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def wide_hashes(texts: list[bytes | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of every word of some texts, and the text it
    is in."""
    known = _Numbers()
    parts = [np.array([known[w] for w in t.split()] if t else [], np.int64) for t in texts]
    data = b"".join(xxhash.xxh3_128_digest(w, seed) for w in known)
    halves = np.frombuffer(data, ">u8").astype(_U).reshape(-1, 2)
    words = np.concatenate([np.empty(0, np.int64), *parts])
    return halves[words, 0], halves[words, 1], np.repeat(np.arange(len(texts)), [len(p) for p in parts])
