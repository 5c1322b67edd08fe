"""Numeric encodings of passages, computed for a whole batch of texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Characters of a passage. Every text has one passage at least; all are encoded.
PASSAGE = 512
#: Classes of characters: lower, upper, digit, space, line end, other letters, the rest by itself.
PLAIN = "abcdefghijklmnopqrstuvwxyz"
MARKS = ".,;:!?'\"()[]{}<>/\\|_-+=*#$%&@~^`"
CLASSES = 8 + len(MARKS)
BIGRAMS = 64
EXTRA = 6
WIDTH = CLASSES + BIGRAMS + EXTRA


@cache
def classes() -> np.ndarray:
    """For each code point below 65536 its class; higher ones are in class 7."""
    out = np.full(0x10000, 6, np.int64)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            out[c] = 5 if c > 127 and x.islower() else 0 if x.islower() else 1 if x.isupper() else 5
        elif x.isdigit():
            out[c] = 2
        elif x in "\n\r":
            out[c] = 4
        elif x.isspace():
            out[c] = 3
    for k, x in enumerate(MARKS):
        out[ord(x)] = 8 + k
    return out


@cache
def bigram_hash() -> np.ndarray:
    return np.random.default_rng(5).integers(0, BIGRAMS, CLASSES * CLASSES)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of features per passage, and each text's number of passages.

    Shares of character classes, hashed shares of class pairs, then mean word
    length, share of distinct words, share of words that repeat the one before,
    share of words ending in marks, size of the passage, and whether it is empty.
    """
    data = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(d) // 4 for d in data), np.int64, len(data))
    many = np.maximum(1, -(-lengths // PASSAGE))
    code = np.frombuffer(b"".join(data), np.uint32).astype(np.int64)
    n = int(many.sum())
    first = np.cumsum(many) - many
    inside = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = np.repeat(first, lengths) + inside // PASSAGE
    kind = np.where(code < 0x10000, classes()[np.minimum(code, 0xFFFF)], 7)
    size = np.bincount(passage, minlength=n).astype(float)
    out = np.zeros((n, WIDTH), np.float32)
    whole = np.maximum(size, 1)[:, None]
    out[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / whole
    if len(code) > 1:
        same = passage[1:] == passage[:-1]
        pair = bigram_hash()[kind[:-1] * CLASSES + kind[1:]]
        out[:, CLASSES : CLASSES + BIGRAMS] = np.bincount((passage[1:] * BIGRAMS + pair)[same], minlength=n * BIGRAMS).reshape(n, BIGRAMS) / whole
    blank = (kind == 3) | (kind == 4)
    if len(code):
        edge = np.r_[True, passage[1:] != passage[:-1]]
        begin = np.flatnonzero(~blank & (edge | np.r_[True, blank[:-1]]))
        stop = np.flatnonzero(~blank & (np.r_[edge[1:], True] | np.r_[blank[1:], True])) + 1
        if len(begin):
            long = stop - begin
            # a word's hash: a sum of its mixed characters by place, by way of running sums
            at = np.arange(len(code)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(code)]))
            with np.errstate(over="ignore"):
                mixed = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * ((at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                mixed ^= mixed >> np.uint64(29)
                running = np.r_[np.uint64(0), np.cumsum(mixed)]
                word = running[stop] - running[begin]
            home = passage[begin]
            words = np.maximum(np.bincount(home, minlength=n), 1)
            order = np.lexsort((word, home))
            fresh = np.r_[True, (word[order][1:] != word[order][:-1]) | (home[order][1:] != home[order][:-1])]
            again = np.r_[False, (word[1:] == word[:-1]) & (home[1:] == home[:-1])]
            extra = out[:, CLASSES + BIGRAMS :]
            extra[:, 0] = np.bincount(home, long, n) / words / 20
            extra[:, 1] = np.bincount(home[order], fresh, n) / words
            extra[:, 2] = np.bincount(home, again, n) / words
            extra[:, 3] = np.bincount(home, kind[stop - 1] >= 8, n) / words
    out[:, -2] = size / PASSAGE
    out[:, -1] = size == 0
    return out, many
