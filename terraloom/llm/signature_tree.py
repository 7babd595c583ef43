"""A tree over token sets whose nodes hold the OR of their sets' bitmaps and the range of their sizes.

The self-join walks pairs of nodes from the root down, level by level.  A pair of nodes is
left out when no two of its sets can overlap enough: by their sizes, by the bits that
both nodes have, or because all of their sets are already known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
#: Bytes of bitmaps that one step of the walk compares at most.
STEP_BYTES = 4 << 20


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` tokens: a power of two, ``n`` at least."""
    return max(256, 1 << max(n - 1, 0).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    flags = np.zeros(width, bool)
    flags[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


class BitmapTree:
    """The tree by sizes, bitmaps of one width and known components; it gives the pairs that the bounds let through."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, comp: np.ndarray, percent: int = 75):
        self.percent = percent
        self.order = np.lexsort((bits[:, 0], size))
        size, bits, comp = size[self.order], bits[self.order], comp[self.order]
        slack = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, slack, comp, comp)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, slack, least, most = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def _able(self, level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a link between two components."""
        bits, low, high, slack, least, most = self.levels[level]
        t = self.percent
        # 100 * o >= t * (a + b - o), so (100 + t) * o >= t * (a + b).
        need = t * (low[p] + low[q])
        able = (100 * high[p] >= t * low[q]) & (100 * high[q] >= t * low[p]) & ((100 + t) * np.minimum(high[p], high[q]) >= need)
        able &= (least[p] != most[p]) | (least[q] != most[q]) | (least[p] != least[q])
        at = np.flatnonzero(able)
        shared = np.bitwise_count(bits[p[at]] & bits[q[at]]).sum(1, dtype=np.int64) + np.minimum(slack[p[at]], slack[q[at]])
        own = p[at] == q[at]
        return at[own | ((100 + t) * shared >= need[at])]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of sets, each once."""
        if not len(self.order):
            return
        step = max(64, STEP_BYTES // (8 * self.levels[0][0].shape[1]))
        start = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, start, start)]
        while stack:
            level, p, q = stack.pop()
            if len(p) > step:
                stack += [(level, p[i : i + step], q[i : i + step]) for i in range(0, len(p), step)][::-1]
                continue
            at = self._able(level, p, q)
            p, q = p[at], q[at]
            if not level:
                apart = p != q
                if apart.any():
                    yield self.order[p[apart]], self.order[q[apart]]
            elif len(p):
                below = len(self.levels[level - 1][1])
                a = np.repeat(p * FAN, FAN * FAN) + np.tile(np.repeat(np.arange(FAN), FAN), len(p))
                b = np.repeat(q * FAN, FAN * FAN) + np.tile(np.tile(np.arange(FAN), FAN), len(p))
                ok = (a < below) & (b < below) & (a <= b)
                stack.append((level - 1, a[ok], b[ok]))


class SignatureTree:
    """``sets`` are sorted arrays of distinct 64-bit tokens; links are pairs with 100 * overlap >= percent * union.

    Sets of one ``known`` name are connected from the start.
    """

    def __init__(self, sets: list[np.ndarray], percent: int = 75, known: list[int] | None = None):
        self.sets, self.percent = sets, percent
        first: dict[int, int] = {}
        self.parent = [first.setdefault(c, i) for i, c in enumerate(range(len(sets)) if known is None else known)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def similar(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if not len(a) or not len(b):
            return False
        both = np.concatenate([a, b])
        both.sort()
        o = int((both[1:] == both[:-1]).sum())
        return 100 * o >= self.percent * (len(a) + len(b) - o)

    def components(self) -> list[int]:
        """For each set the first set of its component; links inside a component are not all looked at."""
        size = np.array([len(x) for x in self.sets], np.int64)
        if len(size):
            width = min(1 << 16, 4 * width_of(int(size.max())))
            bits = np.stack([bitmap(x, width) for x in self.sets])
            for p, q in BitmapTree(size, bits, np.array(self.parent), self.percent).pairs():
                for i, j in zip(p.tolist(), q.tolist(), strict=True):
                    a, b = self.find(i), self.find(j)
                    if a != b and self.similar(i, j):
                        self.parent[max(a, b)] = min(a, b)
        return [self.find(i) for i in range(len(self.sets))]
