"""Gray-order hierarchical index over 64-bit codes: which codes lie within a few bits of each other.

Codes are sorted by their rank in the reflected Gray code, where neighbours share long bit patterns. Sixteen
neighbours make a node, sixteen nodes the node above, up to few top nodes. A node holds the bits that all codes below
it share (mask and pattern), without those that the node above holds already. A search goes down from the top, adds up
the differences to the patterns on its way and leaves a whole group as soon as they exceed the limit.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16
# Pairs of a code and a node that are looked at in one go; bounds memory, not results.
FRONTIER = 1 << 20


def rotate(codes: np.ndarray, bits: int) -> np.ndarray:
    return codes if bits % 64 == 0 else (codes << np.uint64(bits % 64)) | (codes >> np.uint64(64 - bits % 64))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code in the reflected Gray order: the inverse of ``i ^ (i >> 1)``."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    def __init__(self, codes: np.ndarray):
        """``codes`` (unsigned 64 bits) in ascending order of their Gray rank."""
        self.codes, self.levels = codes, []
        both, any_ = codes, codes
        while True:
            starts = np.arange(0, len(both), FANOUT)
            both, any_ = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(any_, starts)
            self.levels.append([~(both ^ any_), both])
            if len(both) <= FANOUT:
                break
        self.levels.reverse()
        for (mask, _), (above, _) in zip(self.levels[:0:-1], self.levels[-2::-1]):
            mask &= ~np.repeat(above, FANOUT)[: len(mask)]
        for level in self.levels:
            level[1] = level[1] & level[0]

    def search(self, queries: np.ndarray, most: int, lead: int, after: np.ndarray | None = None):
        """Yields arrays (query, code) of places: at most ``most`` differing bits, none among the first ``lead``.

        With ``after`` only codes at later places than ``after[query]`` count.
        """
        top = np.uint64(((1 << lead) - 1) << (64 - lead)) if lead else np.uint64(0)
        n = len(self.levels[0][0])
        step = max(1, FRONTIER // n)
        for begin in range(0, len(queries), step):
            q = np.repeat(np.arange(begin, min(len(queries), begin + step)), n)
            node = np.tile(np.arange(n), len(q) // n)
            stack = [(0, q, node, np.zeros(len(q), np.uint8))]
            while stack:
                depth, q, node, sofar = stack.pop()
                last = depth == len(self.levels)
                if last:
                    differ = queries[q] ^ self.codes[node]
                    total = np.bitwise_count(differ)
                else:
                    mask, pattern = self.levels[depth]
                    differ = (queries[q] ^ pattern[node]) & mask[node]
                    total = sofar + np.bitwise_count(differ)
                keep = (total <= most) & (differ & top == 0)
                if after is not None:
                    width = FANOUT ** (len(self.levels) - depth)
                    keep &= (node + 1) * width - 1 > after[q]
                q, node, total = q[keep], node[keep], total[keep]
                if last:
                    if len(q):
                        yield q, node
                    continue
                below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.codes)
                for at in range(0, len(q), FRONTIER // FANOUT):
                    part = slice(at, at + FRONTIER // FANOUT)
                    child = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
                    real = child < below
                    stack.append((depth + 1, np.repeat(q[part], FANOUT)[real], child[real], np.repeat(total[part], FANOUT)[real]))


class Forest:
    """Sets of places, joined by arrays of pairs; the smallest place stands for a set."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            a, b = root[a], root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
