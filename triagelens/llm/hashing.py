"""Vectorised 64-bit digests of byte ranges and words, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240229)
GEAR = _RANDOM.integers(0, 1 << 32, 256, dtype=np.uint32)
LETTER = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Bytes of text that are handled at once; a longer text is taken alone.
AT_ONCE = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def range_digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Digest of ``data[start:stop]`` for every pair, from running sums."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LETTER[data] * powers(BASE, len(data)), out=sums[1:])
    moved = (sums[stops] - sums[starts]) * powers(BACK, len(data) + 1)[starts]
    return mixed(moved + (stops - starts).astype(np.uint64))


def in_groups(texts: list[bytes], limit: int = AT_ONCE) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``limit`` bytes together."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        if group and held + len(text) > limit:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group
