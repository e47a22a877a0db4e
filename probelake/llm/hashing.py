"""Vectorised hashing of bytes, words and word windows inside tasks.

A polynomial hash over a whole buffer, taken as differences of one running sum
in 64-bit arithmetic, gives the hash of any stretch of it at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np

SLICE_BYTES = 1 << 20
# Buffers of over 4 MB go back to the system once freed: a worker would keep their places otherwise (glibc's M_MMAP_THRESHOLD).
if hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(-3, 4 << 20)
U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _powers = tuple(out)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that every bit depends on all."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=U) | U(1)


def running(data: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Running sum whose differences, times an inverse power, are hashes of stretches."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * powers(len(data) + 1)[0][:-1], dtype=U, out=out[1:])
    return out


def stretches(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (run[ends] - run[starts]) * powers(len(run))[1][starts]


def slices(texts: Sequence[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Position of the first text and the UTF-8 bytes of as many as stay within ``limit``; null is empty."""
    held: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(data) > limit:
            yield first, held
            held, first, size = [], i, 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8; other letters are left as they are."""
    out = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    if len(data) > 1:
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        out = out + np.uint8(32) * (after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    return out


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where a mask holds."""
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    return edge[::2], edge[1::2]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each part, and the places where the parts end."""
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), np.cumsum([len(p) + 1 for p in parts])


def shingles(parts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows of the parts, one part after the other, and how many each has.

    Words are what white space separates, in lower case.  A part with fewer words
    than ``words`` has one window of all of them, one without words has none.
    """
    data, ends = joined(parts)
    data = lower(data)
    starts, stops = runs(~_SPACE[data])
    token = mix(stretches(running(data), starts, stops) ^ (stops - starts).astype(U))
    per = np.diff(np.searchsorted(starts, ends), prepend=0)
    first = np.cumsum(per) - per
    count = np.where(per == 0, 0, np.maximum(1, per - words + 1))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    padded = np.r_[token, np.zeros(words, U)]
    left = np.repeat(np.minimum(per, words), count)
    h = np.zeros(len(at), U)
    for k in range(words):
        h = h * U(0xD1342543DE82EF95) + np.where(k < left, padded[at + k], U(0)) + U(1)
    return mix(h), count
