"""Hashes of the words of many texts at once, in numpy: a word is a range of bytes, its hash a difference of prefix sums."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x = x * _M2
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64, for i < n."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end]; equal bytes have equal hashes."""
    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * _powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def ranges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; inside is False at its last place."""
    edge = np.diff(inside.astype(np.int8), prepend=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, a newline after each, and where each text starts."""
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    return np.frombuffer(b"\n".join([*raw, b""]) or b"\n", np.uint8), starts
