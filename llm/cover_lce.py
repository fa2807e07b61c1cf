"""How far two places of a string agree, by a difference cover.

Suffixes are sorted only at places whose remainder by ``VERSUS`` is in a cover: for any two places some shift
of less than ``VERSUS`` brings both onto sorted ones. A question compares that many symbols one by one, and if
all agree, the rest is the least common prefix between two places in the order: a range minimum by a sparse table.
"""

from __future__ import annotations

import numpy as np

# A perfect difference set: each difference modulo 31 comes from one pair (fixed values).
VERSUS, COVER = 31, (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    """For two remainders, the least shift that brings both into the cover."""
    inside = np.zeros(VERSUS, bool)
    inside[list(COVER)] = True
    at = (np.arange(VERSUS)[:, None] + np.arange(VERSUS)) % VERSUS  # remainder, shift
    return np.argmax(inside[at][:, None, :] & inside[at][None, :, :], axis=2)


SHIFT = _shifts()
_nth = np.full(VERSUS, -1)
_nth[list(COVER)] = np.arange(len(COVER))


def agree(string: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols from ``x`` and ``y`` on are equal, up to ``most``; the string ends by a symbol of its own."""
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(most > 0)
    step = 0
    while len(live):
        live = live[string[x[live] + step] == string[y[live] + step]]
        step += 1
        out[live] = step
        live = live[most[live] > step]
    return out


class CoverLCE:
    """Longest common extensions in a string of integers above 0, as arrays of questions."""

    def __init__(self, string: np.ndarray):
        n = len(string)
        self.string = np.zeros(n + 2 * VERSUS, np.int64)
        self.string[:n] = string
        cycles = n // VERSUS + 1
        self.sample = (np.arange(cycles)[:, None] * VERSUS + np.array(COVER)).ravel()
        self.sample = self.sample[self.sample < n]
        self._sort()
        self._table()

    def _sort(self) -> None:
        """Ranks of the sampled suffixes: by their first symbols, then by doubled lengths.

        The sampled place one period on stands ``len(COVER)`` places on in ``sample``.
        """
        m, bits = len(self.sample), max(int(self.string.max(initial=0)).bit_length(), 1)
        per = max(63 // bits, 1)
        keys = []
        for begin in range(0, VERSUS, per):
            key = np.zeros(m, np.int64)
            for i in range(begin, min(begin + per, VERSUS)):
                key = (key << bits) | self.string[self.sample + i]
            keys.append(key)
        order = np.lexsort(keys[::-1]) if m else np.zeros(0, np.int64)
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        self.levels = [self._ranks(order, new)]
        step = len(COVER)
        while m and int(self.levels[-1].max()) < m:
            rank = self.levels[-1]
            after = np.zeros(m, np.int64)
            after[: max(m - step, 0)] = rank[step:]
            key = rank * (m + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.zeros(m, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            self.levels.append(self._ranks(order, new))
            step *= 2
        self.order = order

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks from 1; 0 is left for what lies beyond the end."""
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) + 1
        return rank

    def _table(self) -> None:
        """Common prefixes of neighbours in the order, and minima over ranges of 1, 2, 4 ... of them."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        m, length = len(self.sample), np.zeros(max(len(self.order) - 1, 0), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], len(COVER) << level
            inside = (a < m) & (b < m)
            same = np.zeros(len(a), bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            length[same] += VERSUS << level
            a[same] += step
            b[same] += step
        x, y = self.sample[self.order[:-1]] + length, self.sample[self.order[1:]] + length
        length += agree(self.string, x, y, np.full(len(x), VERSUS))
        self.rank = self.levels[-1] - 1
        del self.levels
        self.minima = [length]
        span = 1
        while 2 * span <= len(length):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension to the right of each two different places."""
        shift = SHIFT[x % VERSUS, y % VERSUS]
        out = agree(self.string, x, y, shift)
        open_ = np.flatnonzero(out == shift)
        at = [p[open_] + shift[open_] for p in (x, y)]
        inside = (at[0] < self.sample[-1] + 1) & (at[1] < self.sample[-1] + 1) if len(self.sample) else np.zeros(len(open_), bool)
        open_ = open_[inside]
        r, s = (self.rank[(p[inside] // VERSUS) * len(COVER) + _nth[p[inside] % VERSUS]] for p in at)
        low, high = np.minimum(r, s), np.maximum(r, s)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            now = level == k
            best = np.minimum(self.minima[k][low[now]], self.minima[k][high[now] - (1 << int(k))])
            out[open_[now]] += best
        return out
