"""64-bit fingerprints of the words of a text, computed by numpy over its bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_POWERS = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _powers(name: str, factor: int, n: int) -> np.ndarray:
    have = _POWERS[name]
    if len(have) < n:
        have = _POWERS[name] = np.concatenate([[U(1)], np.full(2 * n, U(factor))]).cumprod(dtype=U)
    return have[:n]


def word_marks(text: str | None) -> np.ndarray:
    """A fingerprint for each word in order; none for null and wordless texts.

    Words are runs without ASCII white space, A-Z lowered. Each is hashed as a polynomial
    of its bytes, taken from differences of one running sum over the whole text.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.concatenate([[True], _GAP[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, U)
    run = np.concatenate([np.zeros(1, U), (_BYTE[raw] * _powers("up", BASE, len(raw))).cumsum(dtype=U)])
    return mix((run[end] - run[start]) * _powers("down", _INVERSE, len(raw))[start] + (end - start).astype(U))
