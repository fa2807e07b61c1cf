"""Suffix arrays by the difference cover of three (skew algorithm), in numpy.

Suffixes at two of every three places are sorted by their first three symbols; equal triples are told
apart by sorting the string of the triples' names in the same way. The other suffixes follow from their
first symbol and the rank of the next suffix, and are merged in.
"""

from __future__ import annotations

import numpy as np


def _order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by several columns of small integers, as one sort of packed numbers if they fit."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    return np.argsort(_packed(columns, bits), kind="stable")


def _packed(columns, bits) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.int64)
    for c, b in zip(columns, bits):
        out = (out << b) | c
    return out


def _positions(mine, theirs) -> np.ndarray:
    """How many of the sorted rows ``theirs`` come before each of ``mine``; both are tuples of columns."""
    bits = [max(int(m.max(initial=0)), int(t.max(initial=0))).bit_length() for m, t in zip(mine, theirs)]
    if sum(bits) <= 63:
        return np.searchsorted(_packed(theirs, bits), _packed(mine, bits))
    both = [np.concatenate([m, t]) for m, t in zip(mine, theirs)]
    order = np.lexsort(both[::-1])
    before = np.cumsum(order >= len(mine[0]))
    out = np.empty(len(order), np.int64)
    out[order] = before
    return out[: len(mine[0])]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order. Symbols are integers above 0."""
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = symbols
    places = np.arange(n + (n % 3 == 1))
    sample = np.concatenate([places[places % 3 == 1], places[places % 3 == 2]])
    ones = int((places % 3 == 1).sum())
    order = _order(s[sample], s[sample + 1], s[sample + 2])
    ordered = sample[order]
    new = np.ones(len(ordered), np.int64)
    same = np.ones(len(ordered) - 1, bool)
    for i in range(3):
        same &= s[ordered[1:] + i] == s[ordered[:-1] + i]
    new[1:] = ~same
    names = np.cumsum(new)
    rank = np.zeros(n + 4, np.int64)
    if names[-1] < len(names):
        word = np.empty(len(sample), np.int64)
        word[order] = names
        ordered = sample[suffix_array(word)]
    rank[ordered] = np.arange(1, len(ordered) + 1)
    ordered = ordered[ordered < n]  # the padding's own suffix
    rest = np.arange(0, n, 3)
    rest = rest[_order(s[rest], rank[rest + 1])]
    one, two = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = _positions((s[rest], rank[rest + 1]), (s[one], rank[one + 1]))
    before += _positions((s[rest], s[rest + 1], rank[rest + 2]), (s[two], s[two + 1], rank[two + 2]))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = ordered
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Of windows of ``width`` bytes at ``starts``, those that a smaller owner has too.

    The suffixes that begin a window are put in order; neighbours with equal prefixes are one window.
    """
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    of_place = np.full(len(data), -1, np.int64)
    of_place[starts] = np.arange(len(starts))
    places = suffix_array(data.astype(np.int64) + 1)
    which = of_place[places]
    which = which[which >= 0]
    at = starts[which]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.zeros(len(data), np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | padded[i : i + len(data)]
    same = np.ones(len(at) - 1, bool)
    full, left = divmod(width, 8)
    for step in [8 * i for i in range(full)] + ([width - 8] if left and width >= 8 else []):
        same &= eight[at[1:] + step] == eight[at[:-1] + step]
    if width < 8:
        shift = np.uint64(8 * (8 - width))
        same &= eight[at[1:]] >> shift == eight[at[:-1]] >> shift
    head = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(owner[which], head)
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
    out[which] = owner[which] > least[group]
    return out
