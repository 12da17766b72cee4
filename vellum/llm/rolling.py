"""Polynomial hashes of any range of a byte buffer, from its prefix sums. They find candidates; equality is checked on the
bytes, as ranges such as Thue-Morse words agree in these hashes whatever the base."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240101)
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_held: dict[int, np.ndarray] = {}
#: Powers of a base that a worker keeps.
HELD_POWERS = 1 << 22


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** k`` modulo 2 ** 64 for k below n."""
    held = _held.get(int(base), np.zeros(0, np.uint64))
    if len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= HELD_POWERS:
            _held[int(base)] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))
