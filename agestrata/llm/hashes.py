"""Hashes of all stretches of a sequence, by sums of powers modulo 2**64."""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of r and of its inverse modulo 2**64."""
    if r not in _powers or len(_powers[r][0]) < n:
        most = max(n, 1 << 16)
        _powers[r] = tuple(np.concatenate(([_U(1)], np.cumprod(np.full(most, x & _M, np.uint64)))) for x in (r, pow(r, -1, 1 << 64)))
    return _powers[r]


def _sums(raw: np.ndarray, r: int) -> np.ndarray:
    return np.concatenate(([_U(0)], np.cumsum((raw.astype(np.uint64) + _U(1)) * _power(r, len(raw))[0][: len(raw)])))


def hashed(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each stretch of raw."""
    sums = _sums(raw, _R)
    return mixed((sums[end] - sums[begin]) * _power(_R, len(raw))[1][begin])


def rolled(raw: np.ndarray, n: int) -> np.ndarray:
    """The hash of each stretch of n."""
    sums = _sums(raw, _R)
    return mixed((sums[n:] - sums[:-n]) * _power(_R, len(raw))[1][: len(raw) - n + 1])


def least(h: np.ndarray, wide: int) -> np.ndarray:
    """Where the leftmost least of each `wide` hashes in a row is, by their upper 32 bits."""
    low, step = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while step * 2 <= wide:  # low[i] covers step hashes from i on
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    n = len(h) - wide + 1
    return (np.minimum(low[:n], low[wide - step : wide - step + n]) & _U(0xFFFFFFFF)).astype(np.int64)
