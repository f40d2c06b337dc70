"""Hashes of any slice of a code array in constant time each, vectorised over all slices."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Odd multiplier of the polynomial and its inverse modulo 2**64.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[name] = have
    return have[:n]


class Rolling:
    """Prefix sums of codes times powers modulo 2**64; equal slices have equal hashes wherever they lie."""

    def __init__(self, codes: np.ndarray, salt: int = 0):
        n = len(codes)
        values = mix64(codes.astype(np.uint64) + np.uint64(1 + salt))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power("up", MULTIPLIER, n), out=self.sums[1:])
        self.n = n

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _power("down", INVERSE, self.n + 1)
        return mix64((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def grams(self, q: int) -> np.ndarray:
        """The hash of each run of q codes, in order."""
        if self.n < q:
            return np.zeros(0, np.uint64)
        back = _power("down", INVERSE, self.n + 1)
        return mix64((self.sums[q:] - self.sums[:-q]) * back[: self.n - q + 1] + np.uint64(q))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text starts (with the end as last)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]


def is_space(codes: np.ndarray) -> np.ndarray:
    """Tab to carriage return, and space; unsigned differences wrap around."""
    return (codes - np.uint32(9) <= 4) | (codes == 32)


def words_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word (runs of no ASCII white space); words end where texts do."""
    inside = ~is_space(codes)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(codes))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lower_ascii(codes: np.ndarray) -> np.ndarray:
    return codes | (codes - np.uint32(65) <= 25).astype(np.uint32) << np.uint32(5)  # capitals lack that bit
