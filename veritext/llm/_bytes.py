"""Vectorised work on UTF-8 bytes: words, rolling hashes, n-gram hashes.

All word classes of the operators are closed over ASCII, so that words can be cut on bytes.
Hashes of byte ranges come from prefix sums of a polynomial over 64-bit words; a range costs
two look-ups whatever its length.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words; works in place on a fresh copy."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_LEN = U(0xA0761D6478BD642F)


def _size_code(size: int) -> np.uint64:
    return U((size * int(_LEN)) & 0xFFFFFFFFFFFFFFFF)


_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 1 << 19)
        have = np.full(size, U(_BASE if kind == "up" else _INVERSE))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:  # longer texts are rare; theirs isn't kept
            _powers[kind] = have
    return have[:n]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums for span_hash."""
    n = len(buf)
    out = np.zeros(n + 1, U)
    x = _CODES[buf]
    x *= _power("up", n)
    np.cumsum(x, out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each [start, end)."""
    x = pre[end] - pre[start]
    x *= _power("down", len(pre))[start]
    x += (end - start).astype(U) * _LEN
    return mix(x)


def window_hash(pre: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ranges of `size` bytes, by their first byte."""
    n = len(pre) - size
    if n <= 0:
        return np.empty(0, U)
    x = pre[size:] - pre[:n]
    x *= _power("down", n)
    x += _size_code(size)
    return mix(x)


def _table(other: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(other)] = False
    return t


#: Bytes of words between white space: everything but 0x20 and 0x09-0x0D.
SPACED = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: Bytes of plain words: digits, letters and everything beyond ASCII.
PLAIN = _table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word and, per row, the number of the first word (one more at the end)."""
    n = len(buf)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    m = kind[buf]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    rows = offs[:-1][offs[:-1] < offs[1:]]
    first[rows] = m[rows]
    rows = offs[1:][offs[:-1] < offs[1:]] - 1
    last[rows] = m[rows]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


_STEP = [int(x) | 1 for x in mix(np.arange(100, 164, dtype=U))]


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive word hashes, by the first word; rows are not looked at."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, U)
    x = np.zeros(n, U)
    for i in range(size):
        x += codes[i : i + n] * U(_STEP[i % 64])
        x ^= x >> U(29)
    x += _size_code(size)
    return mix(x)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """Which words begin a run of `size` words in their own row. first: from words()."""
    total = int(first[-1]) if len(first) else 0
    ok = np.zeros(max(total - size + 1, 0), bool)
    if len(ok):
        end = np.repeat(first[1:], np.diff(first))
        ok = np.arange(len(ok)) + size <= end[: len(ok)]
    return ok


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
