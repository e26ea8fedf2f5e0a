"""Polynomial hashes of words and windows over blocks of texts, in numpy.

Words have their 64-bit XXH64. Windows have polynomials modulo the prime 2**61 - 1 at a fixed point,
so two different strings of ``n`` symbols have equal hashes for at most ``n`` of the 2**61 points,
whatever they are made of.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

#: The modulus, a prime.
_P = (1 << 61) - 1
_MASK = np.uint64(_P)
_BASE = 0x9E3779B97F4A7C15 % _P
#: A second point, for runs that must be told apart by more than 61 bits.
_SECOND = 0xD1B54A32D192ED03 % _P
_SYMBOL = np.random.default_rng(20240131).integers(1, _P, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}
_LOW32, _LOW31, _LOW30 = (np.uint64((1 << n) - 1) for n in (32, 31, 30))
_1, _29, _30, _31, _32, _61 = (np.uint64(x) for x in (1, 29, 30, 31, 32, 61))
#: Elements multiplied at once, so that what is in between stays in the cache.
_PIECE = 1 << 13

#: Bytes of text hashed at once; a longer document makes a block of its own.
BLOCK_BYTES = 4 << 20


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for any 64-bit values."""
    x = (x & _MASK) + (x >> _61)
    return np.minimum(x, x - _MASK)  # what is below the prime wraps round to more


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a * b`` modulo the prime, of values below it."""
    out = np.empty(len(a), np.uint64)
    scratch = np.empty((5, min(len(a), _PIECE)), np.uint64)
    for at in range(0, len(a), _PIECE):
        x, y = a[at : at + _PIECE], b[at : at + _PIECE]
        xh, yh, xl, yl, mid = scratch[:, : len(x)]
        np.right_shift(x, _31, out=xh)
        np.right_shift(y, _31, out=yh)
        np.bitwise_and(x, _LOW31, out=xl)
        np.bitwise_and(y, _LOW31, out=yl)
        np.multiply(xl, yh, out=mid)
        yh *= xh
        xh *= yl
        mid += xh
        xl *= yl
        yh <<= _1  # 2**62 is 2
        xl += yh
        np.right_shift(mid, _30, out=yh)  # 2**61 is 1
        xl += yh
        mid &= _LOW30
        mid <<= _31
        xl += mid
        np.bitwise_and(xl, _MASK, out=mid)
        xl >>= _61
        mid += xl
        np.subtract(mid, _MASK, out=xl)
        np.minimum(mid, xl, out=out[at : at + len(x)])
    return out


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), _P))
        have = np.concatenate([have, multiply(have, np.full(len(have), step))])
    _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prefix:
    """Hashes of any runs of a sequence of 64-bit symbols; equal runs hash alike wherever they are."""

    def __init__(self, symbols: np.ndarray, second: bool = False):
        n, base = len(symbols), _SECOND if second else _BASE
        self.sums = np.zeros(n + 1, np.uint64)
        self.undo = _power(pow(base, -1, _P), n + 1)
        power, carry = _power(base, n), np.uint64(0)
        for at in range(0, n, _PIECE):  # in pieces that stay in the cache
            terms = multiply(_fold(symbols[at : at + _PIECE]), power[at : at + _PIECE])
            # halves of the terms add up without overflow; the upper sum, times 2**32, is turned by 32 of 61 bits
            high = _fold(np.cumsum(terms >> _32))
            high = ((high << _32) & _MASK) | (high >> _29)
            high += np.cumsum(terms & _LOW32)
            self.sums[at + 1 : at + 1 + len(terms)] = done = _fold(_fold(high) + carry)
            carry = done[-1]

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for at in range(0, len(start), _PIECE):
            a, b = start[at : at + _PIECE], end[at : at + _PIECE]
            out[at : at + len(a)] = mix(multiply(_fold(self.sums[b] + (_MASK - self.sums[a])), self.undo[a]))
        return out


def byte_prefix(raw: np.ndarray) -> Prefix:
    return Prefix(_SYMBOL[raw])


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents of about ``limit`` bytes, one document at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


class Words:
    """The words of a block of texts: byte offsets, hashes, and the document of each."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join([b"", *texts, b""])
        arr = np.frombuffer(self.raw, np.uint8)
        blank = _SPACE[arr]
        turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.end = turn[::2], turn[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes)]) + 1)
        #: of each document, the index of its first word, and one past the last word of all
        self.first = first
        self.count = np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.pos = np.arange(len(self.start)) - first[:-1][self.doc]
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n, step = len(self.start), 1 << 16
            parts = (self.raw[self.start[i] : self.end[min(i + step, n) - 1]].split() for i in range(0, n, step))
            self._hash = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(parts)), np.uint64, n)
        return self._hash
