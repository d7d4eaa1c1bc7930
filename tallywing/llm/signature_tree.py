"""Signature trees: a join of token sets by dual traversal.

Each set has a bitmap with a bit for each token; a node of the tree holds the OR of the bitmaps below
it, the range of their sizes and the most tokens of a set that share a bit with another. Two sets
below a pair of nodes have at most as many tokens in common as the nodes have bits, plus those that
share bits; a pair of nodes whose bound misses the overlap that its smallest sizes ask for is left.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
PAIRS_AT_ONCE = 8192


class SignatureTree:
    def __init__(self, sets: list[np.ndarray]):
        most = max((len(s) for s in sets), default=1)
        bits = min(1 << 14, max(1 << 10, 1 << (2 * most - 1).bit_length()))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            place = s & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        size = np.array([len(s) for s in sets], np.int64)
        shared = size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, size, size, shared)]
        while len(self.levels[-1][0]) > FANOUT:
            maps, least, most_, shared = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most_, at), np.maximum.reduceat(shared, at)))

    def pairs(self, percent: int):
        """Yields arrays of i < j that can have a Jaccard similarity of percent / 100; no pair that has it is left out."""
        n = len(self.levels[-1][0])
        i, j = np.triu_indices(n)
        yield from self._below(len(self.levels) - 1, i, j, percent)

    def _below(self, level: int, i: np.ndarray, j: np.ndarray, percent: int):
        maps, least, most, shared = self.levels[level]
        if level == 0:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), PAIRS_AT_ONCE):
            x, y = i[a : a + PAIRS_AT_ONCE], j[a : a + PAIRS_AT_ONCE]
            sizes_fit = (100 * most[x] >= percent * least[y]) & (100 * most[y] >= percent * least[x])
            x, y = x[sizes_fit], y[sizes_fit]
            common = np.bitwise_count(maps[x] & maps[y]).sum(axis=1).astype(np.int64) + np.minimum(shared[x], shared[y])
            good = (100 + percent) * common >= percent * (least[x] + least[y])
            x, y = x[good], y[good]
            if not len(x):
                continue
            if level == 0:
                yield x, y
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(FANOUT)
            c = (x[:, None, None] * FANOUT + step[None, :, None] + np.zeros_like(step)[None, None, :]).ravel()
            d = (y[:, None, None] * FANOUT + step[None, None, :] + np.zeros_like(step)[None, :, None]).ravel()
            ok = (c < below) & (d < below) & (c <= d)
            yield from self._below(level - 1, c[ok], d[ok], percent)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays of distinct tokens have a Jaccard similarity of at least percent / 100."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def linked(sets: list[np.ndarray], label: np.ndarray, percent: int) -> np.ndarray:
    """For each set the smallest index among the sets that it reaches by links or by equal labels.

    Only pairs not yet known to be together are measured.
    """
    root = np.arange(len(sets))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(x: int, y: int) -> None:
        a, b = top(x), top(y)
        if a != b:
            root[max(a, b)] = min(a, b)

    first: dict[int, int] = {}
    for i, v in enumerate(label.tolist()):
        join(i, first.setdefault(v, i))
    for x, y in SignatureTree(sets).pairs(percent):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if top(i) != top(j) and similar(sets[i], sets[j], percent):
                join(i, j)
    return np.array([top(i) for i in range(len(sets))], np.int64)
