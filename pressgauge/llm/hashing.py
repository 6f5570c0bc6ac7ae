"""Whole-array hashing of words and shingles in tasks."""

from __future__ import annotations

import numpy as np

# Fixed values of the splitmix64 finaliser, a published bit mixer.
_MIX_ADD, _MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + _MIX_ADD
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256))
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64) if n else out


def inverse(base: np.uint64 = _ODD) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def running(data: np.ndarray) -> np.ndarray:
    """Sums from which (sums[b] - sums[a]) * powers(n, inverse())[a] is a hash of the bytes from a to b."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), dtype=np.uint64, out=sums[1:])
    return sums


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts laid end to end, and the place of each text's first word (n + 1 places)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _IS_BLANK[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = ~blank[edges]
    starts = np.flatnonzero(opens)
    # a word ends before a blank, or where its text does
    closes = ~blank
    closes[:-1] &= blank[1:]
    closes[edges - 1] = ~blank[edges - 1]
    ends = np.flatnonzero(closes) + 1
    sums = running(data)
    hashes = (sums[ends] - sums[starts]) * powers(n, inverse())[starts]
    return mix(hashes), np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, times) of every distinct shingle of `size` words, in order of text and hash.

    A text of fewer words has one shingle, all of its words; one without words has none.
    """
    hashes, first = words(data, offsets)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(len(hashes), np.uint64)
    steps = powers(size)
    for k in range(size):
        if k >= len(hashes):
            break
        inside = text[k:] == text[: len(text) - k]
        total[: len(hashes) - k] += np.where(inside, hashes[k:] * steps[k], np.uint64(0))
    # shingle i of a text of n words: i <= n - size, or i = 0
    at = np.arange(len(hashes)) - first[:-1][text]
    valid = at <= np.maximum(counts[text] - size, 0)
    text, total = text[valid], mix(total[valid])
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    places = np.flatnonzero(new)
    return text[places], total[places], np.diff(np.append(places, len(text)))
