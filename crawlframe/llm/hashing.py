"""Hashes of words, shingles and byte windows of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, 1 << 16), base, dtype=U)
        factors[0] = 1
        _powers[base] = held = np.multiply.accumulate(factors)
    return held[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers of BASE, modulo 2^64; n + 1 of them."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(BYTES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end); equal bytes have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the number of words of each text. fold: lower-case A-Z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if fold:
        data = lower(data)
    gap = is_space(data)
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], bounds])))
    return spans(prefix(data), start, end), counts
