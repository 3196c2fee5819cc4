"""Spans of bytes as numbers, for many spans of a buffer at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
GOLD = _U(0x9E3779B97F4A7C15)
#: Which bytes of eight a span of so many bytes has.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """From each place on (the end too) eight bytes as a number, zeros following the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of bytes [first, end), none of them empty: equal bytes, equal hashes.

    A span's eights are mixed, then mixed again with their place in it, and added up. Unlike powers of
    a base modulo 2^64, whose sums some regular texts defeat, every term is as good as random.
    """
    if not len(first):
        return np.zeros(0, _U)
    eight, size = eights(data), end - first
    parts = (size + 7) >> 3
    start = np.cumsum(parts) - parts
    nth = np.arange(int(parts.sum())) - np.repeat(start, parts)
    at = np.repeat(first, parts) + 8 * nth
    value = eight[at] & KEEP[np.minimum(np.repeat(end, parts) - at, 8)]
    terms = mix(mix(value ^ GOLD) + (nth + 1).astype(_U) * GOLD)
    return mix(np.add.reduceat(terms, start) + size.astype(_U))


def sixteens(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each span and the next eight, as numbers; with its length they are a span of up to 16 bytes."""
    eight, size = eights(data), end - first
    return eight[first] & KEEP[np.minimum(size, 8)], eight[np.minimum(first + 8, len(data))] & KEEP[np.clip(size - 8, 0, 8)]
