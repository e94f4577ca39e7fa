"""Hashed words and word sequences of whole batches of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each position on; empty if there are fewer."""
    size = max(0, len(hashes) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * _A + hashes[k:k + size]
    return mixed(h)


def offsets(sizes: list[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64)))).astype(np.int64)
