"""64-bit hashes of all words of a block of bytes at once, without an object a word."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
#: Longer words are hashed one by one: sums of powers of an odd base repeat themselves on long patterned texts.
LONG = 255
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least; kept by the worker."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        _powers[:] = [
            np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)))
            for base in (_BASE, _BACK)
        ]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each ``data[start:end]`` (bytes as uint8)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, back = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:], dtype=np.uint64)
    size = (ends - starts).astype(np.uint64)
    found = mix(mix((total[ends] - total[starts]) * back[starts]) + size * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
    for i in np.flatnonzero(ends - starts > LONG):
        found[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed & 0xFFFFFFFFFFFFFFFF)
    return found


def bounds(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate((np.zeros(1, np.int8), is_word.view(np.int8), np.zeros(1, np.int8)))))
    return edge[::2], edge[1::2]
