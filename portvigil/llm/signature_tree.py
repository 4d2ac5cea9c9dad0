"""Signature trees over sets of tokens, and the join of a tree with itself.

A leaf is a set; a node holds the OR of its children's token bitmaps and the range of their sizes.  Two nodes are
visited together only while their bitmaps leave room for an overlap that two of their sets need.  The bitmap of a set
may hold fewer bits than the set has tokens; a node keeps the largest such excess, so the bound is never too low.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16
_LEAST_BITS, _MOST_BITS = 256, 16_384
#: Bits of a bitmap per token of an average set.
_ROOM = 4


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted arrays without repeats, have 100 * intersection >= percent * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], fanout: int = FANOUT):
        """``sets`` are sorted arrays of 64-bit tokens, none of them empty; alike sets should be near each other."""
        self.sets, self.fanout = sets, fanout
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        bits = 1 << int(np.clip(_ROOM * sizes.mean(), _LEAST_BITS, _MOST_BITS) - 1).bit_length()
        maps = np.zeros((len(sets), bits), dtype=np.uint8)
        for row, tokens in zip(maps, sets, strict=True):
            row[(tokens >> np.uint64(40)).astype(np.int64) & (bits - 1)] = 1
        level = np.packbits(maps, axis=1).view(np.uint64)
        excess = sizes - np.bitwise_count(level).sum(axis=1, dtype=np.int64)
        #: From the sets up: bitmaps, largest excess, least and largest size of every node.
        self.levels = [(level, excess, sizes, sizes)]
        while len(level) > 1:
            level, excess, least, most = self.levels[-1]
            cuts = np.arange(0, len(level), fanout)
            level = np.bitwise_or.reduceat(level, cuts, axis=0)
            self.levels.append((level, np.maximum.reduceat(excess, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))

    def _room(self, level: int, a: range, b: range, percent: int) -> np.ndarray:
        """For all nodes of ``a`` and ``b`` whether the overlap that two of their sets need is possible."""
        maps, excess, least, most = self.levels[level]
        one, two = slice(a.start, a.stop), slice(b.start, b.stop)
        both = np.bitwise_count(maps[one, None, :] & maps[None, two, :]).sum(axis=2, dtype=np.int64)
        both += np.minimum(excess[one, None], excess[None, two])
        overlap = np.minimum(both, np.minimum(most[one, None], most[None, two]))
        return (100 + percent) * overlap >= percent * (least[one, None] + least[None, two])

    def _below(self, level: int, node: int) -> range:
        """Children of a node."""
        return range(node * self.fanout, min((node + 1) * self.fanout, len(self.levels[level - 1][0])))

    def join(self, percent: int, labels: np.ndarray) -> list[tuple[int, int]]:
        """Places of linked sets, enough of them to connect what all links and equal ``labels`` connect.

        A node pair whose sets all have one label already is not visited.
        """
        labels, out = labels.copy(), []
        under = [self.fanout**n for n in range(len(self.levels))]

        def settled(level: int, a: int, b: int) -> bool:
            one = labels[a * under[level] : (a + 1) * under[level]]
            two = labels[b * under[level] : (b + 1) * under[level]]
            return bool((one == one[0]).all() and (two == one[0]).all())

        def meet(level: int, a: int, b: int) -> None:
            one, two = self._below(level, a), self._below(level, b)
            room = self._room(level - 1, one, two, percent)
            if a == b:
                if level > 1:
                    for node in one:
                        meet(level - 1, node, node)
                room = np.triu(room, 1)
            for i, j in np.argwhere(room).tolist():
                x, y = one[i], two[j]
                if level > 1:
                    if not settled(level - 1, x, y):
                        meet(level - 1, x, y)
                elif labels[x] != labels[y] and linked(self.sets[x], self.sets[y], percent):
                    out.append((x, y))
                    labels[labels == labels[y]] = labels[x]

        if len(self.levels) > 1:
            meet(len(self.levels) - 1, 0, 0)
        return out
