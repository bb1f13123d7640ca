"""Rolling hashes and content-chosen anchors over bytes, with numpy."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20_240_917)
_VALUE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept and doubled as longer texts come."""
    while len(_POWERS[0]) < n:
        k = len(_POWERS[0])
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * np.uint64(pow(base, k, 2**64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value over all of them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolled:
    """Hash of any range of some bytes in constant time, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * power[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


def anchors(rolled: Rolled, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of ``length`` bytes, the gram with the smallest hash (the first of equals) is its anchor, so equal
    windows have equal anchors at equal offsets. Returns for each run of windows with one anchor: hash of the anchor's
    gram, its place, first and last window start."""
    grams = rolled.every(gram)
    ordered = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(ordered, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    return grams[place[first]], place[first], first, last
