"""Hashed word shingles of whole texts, computed for a batch at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Fixed odd multipliers of a shingle's words, and the finaliser's (splitmix64).
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, which is a bijection of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts data[bounds[i]:bounds[i+1]] (UTF-8), and the words' texts.

    A-Z count as a-z; words are runs of bytes other than 0x20 and 0x09 to 0x0D. A
    word's hash is the sum of mixed (byte, place) pairs.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(~blank & (edge[:-1] | np.r_[True, blank[:-1]]))
    stop = np.flatnonzero(~blank & (edge[1:] | np.r_[blank[1:], True])) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(data)]))
    value = mixed((place.astype(np.uint64) << np.uint64(8)) + low + np.uint64(1))
    value[blank] = 0
    with np.errstate(over="ignore"):
        running = np.cumsum(value)
        words = running[stop - 1] - np.where(begin > 0, running[begin - 1], 0)
    return words, np.searchsorted(bounds, begin, "right") - 1


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each text its distinct shingle hashes, sorted: all in a row, and their bounds."""
    n = len(bounds) - 1
    words, home = word_hashes(data, bounds)
    count = np.bincount(home, minlength=n)
    first = np.cumsum(count) - count
    at = np.flatnonzero(np.arange(len(words)) - first[home] + size <= count[home]) if len(words) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashed = np.zeros(len(at), np.uint64)
        for k in range(size):
            hashed += mixed(words[at + k] + np.uint64(k + 1)) * _PLACE[k % len(_PLACE)]
        hashed = mixed(hashed)
        owner = home[at] if len(at) else np.zeros(0, np.int64)
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):  # fewer words than a shingle has: all of them are one
            short = np.zeros(len(few), np.uint64)
            for k in range(size - 1):
                has = count[few] > k
                short[has] += mixed(words[first[few[has]] + k] + np.uint64(k + 1)) * _PLACE[k]
            hashed = np.r_[hashed, mixed(short + count[few].astype(np.uint64))]
            owner = np.r_[owner, few]
            order = np.argsort(owner, kind="stable")
            hashed, owner = hashed[order], owner[order]
    many = np.bincount(owner, minlength=n)
    ends = np.cumsum(many)
    out, sizes = [], np.zeros(n, np.int64)
    for i in np.flatnonzero(many):
        part = np.unique(hashed[ends[i] - many[i] : ends[i]])
        sizes[i] = len(part)
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.r_[0, np.cumsum(sizes)]
