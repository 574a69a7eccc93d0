"""Sampled suffixes of texts: positions chosen by content, with hashes of their contexts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes of a match, and of the gram that a sampled suffix starts with. Every match of
#: LENGTH bytes holds a sampled suffix, at the same offset wherever it occurs.
LENGTH, GRAM = 100, 32
_RANDOM = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _RANDOM.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Powers kept in a worker, enough for a step of texts; those of a longer text are not kept.
KEPT = (1 << 20) + 2


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT) if n <= KEPT else _powers.__wrapped__(n)


class Hashed:
    """Polynomial hashes of all substrings of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _powers_for(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def sampled(data: np.ndarray, starts: np.ndarray, length: int = LENGTH,
            gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The sampled suffixes of the texts that lie in ``data`` between ``starts``.

    A window of ``length`` bytes samples the suffix at the least hash among its grams, the
    first of equal ones. Neighbouring windows with the same suffix are one record: hash of
    the gram, hash of all bytes of these windows with the suffix's place in them, text
    number, first window's start in its text, windows. A text shorter than ``length`` has
    none.
    """
    empty = np.zeros(0, np.uint64)
    n = len(data)
    if n < length:
        return empty, empty, empty.astype(np.int64), empty.astype(np.int64), empty.astype(np.int64)
    hashed = Hashed(data)
    bits = np.uint64(max(20, n.bit_length()))
    ranks = mixed(hashed.every(gram)) >> bits << bits | np.arange(n - gram + 1, dtype=np.uint64)
    anchor = (_least(ranks, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:len(anchor)]
    inside = np.arange(len(anchor)) + length <= starts[1:][text]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change & inside)
    # Windows that cross into the next text end a record too.
    ends = np.flatnonzero(np.append(change[1:] | ~inside[1:], True) & inside) + 1
    count = ends - first
    at = anchor[first]
    context = hashed.of(first, count + length - 1) ^ mixed((at - first).astype(np.uint64) + np.uint64(1))
    return hashed.of(at, gram), context, text[first], first - starts[text[first]], count
