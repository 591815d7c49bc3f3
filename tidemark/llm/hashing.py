"""Hashes of words and of runs of words, for whole batches with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)  # fixed odd multipliers


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair (a, b)."""
    h = (a * _A) ^ ((b + _B) * _C)
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every ``k`` consecutive entries, put together from runs
    whose lengths are powers of two."""
    out, length, power, runs = None, 0, 1, h
    while True:
        if k & power:
            out = runs[: len(h) - k + 1] if out is None else mixed(out, runs[length: length + len(h) - k + 1])
            length += power
        power *= 2
        if power > k or len(h) < k:
            return np.empty(0, np.uint64) if len(h) < k else out
        runs = mixed(runs[: -(power // 2)], runs[power // 2:])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every ``w`` consecutive entries."""
    if len(h) < w:
        return np.empty(0, h.dtype)
    have, low = 1, h
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low
