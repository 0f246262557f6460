"""Hashes of all words or pieces of a byte string at once, by numpy: a rolling polynomial modulo 2**64, then mixed."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Two tables of the bytes' values, for two hashes that have nothing to do with each other.
_VALUES = [np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1) for seed in (2024, 2025)]
_powers: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[list(b" \t\n\x0b\x0c\r")] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2**64; kept for slices of the usual size."""
    known = _powers.get(str(base))
    if known is None or len(known) <= n:
        known = np.full(n + (1 << 12), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n < 1 << 23:
            _powers[str(base)] = known
    return known


def prefix(data: np.ndarray, table: int = 0) -> np.ndarray:
    """Sums that `pieces` needs; data: uint8; table: 0 or 1, for one hash or another."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[table][data] * _power(_BASE, len(data))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def pieces(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each data[start : end]; equal bytes have equal hashes."""
    raw = (sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes that aren't ASCII white space."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~WHITE[data]
    change = np.diff(solid)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)
