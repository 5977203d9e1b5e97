"""Words of UTF-8 texts and their hashes, a whole batch at a time in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is the sum of one
pseudo-random value for each byte at its place, taken as a difference of one running
sum; a polynomial over places would give equal hashes to some texts of any base. Hashes
of runs are polynomials over those of their few words. A finaliser spreads
both. They are the same in every process.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@functools.cache
def _values(fold: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


@functools.lru_cache(4)
def _powers_of(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        with np.errstate(over="ignore"):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(base, max(19, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(33))
        x = x * U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U(33))
        x = x * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words; document i has the words first[i]:first[i + 1].
    breaks: for each byte value, whether it parts words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def _running(data: np.ndarray, start: np.ndarray, fold: bool) -> np.ndarray:
    """Running sums over the values of bytes at their place in their word."""
    place = np.arange(len(data), dtype=np.uint64)
    place[start[0] :] -= np.repeat(start, np.diff(start, append=len(data))).astype(np.uint64)
    with np.errstate(over="ignore"):
        place *= U(_BYTE_BASE)
        place += _values(fold)[data]
        place ^= place >> U(32)
        place *= U(0xFF51AFD7ED558CCD)
        place ^= place >> U(29)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(place, out=total[1:])
    return total


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """One 64-bit hash per word; with fold, A-Z count as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = _running(data, start, fold)
    with np.errstate(over="ignore"):
        return mix(total[end] - total[start] + (end - start).astype(np.uint64))


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...], fold: bool = False) -> np.ndarray:
    """A row of hashes per word: of the whole word, then of its first bytes by each size
    (0 where it is no longer than that)."""
    if not len(start):
        return np.zeros((0, len(sizes) + 1), np.uint64)
    out = np.zeros((len(start), len(sizes) + 1), np.uint64)
    total = _running(data, start, fold)
    with np.errstate(over="ignore"):
        out[:, 0] = mix(total[end] - total[start] + (end - start).astype(np.uint64))
        for i, n in enumerate(sizes, 1):
            long = np.flatnonzero(end - start > n)
            at = start[long]
            out[long, i] = mix(total[at + n] - total[at] + U(n + 1000003))
    return out


def joined(text: str | None, fold: bool = False) -> bytes:
    """The words of a text joined by one space; with fold, A-Z as a-z."""
    data = (text or "").encode()
    return b" ".join((data.lower() if fold else data).split())


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; the caller drops runs that cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(_WORD_BASE, len(hashes))
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[:n] + U(k))
