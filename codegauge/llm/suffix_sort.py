"""Suffix sorting by hashes: a bottom-up mergesort whose comparisons find the common extension of two suffixes by
binary search over prefix polynomial hashes, with the equal ones verified byte by byte."""

from __future__ import annotations

import numpy as np

from .common import MULT, by_splitmix, inverse

_BYTE = by_splitmix(256, 23)
_POWERS: dict[str, np.ndarray] = {}
PAIRS = 1 << 14  # pairs compared at a time, so that what a halving makes stays in the cache


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``MULT ** i`` and its inverse mod 2**64 for i < n; kept for the worker."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            for name, base in (("up", MULT), ("down", np.uint64(inverse()))):
                t = np.full(size, base, np.uint64)
                t[0] = 1
                np.multiply.accumulate(t, out=t)
                _POWERS[name] = t
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 sums of byte values times powers; a substring's hash is a difference times an inverse power."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        val = _BYTE[data]
        val *= powers(len(data))[0]
        np.cumsum(val, out=out[1:])
    return out


class Suffixes:
    """Suffixes of ``data`` at ``starts``, told apart by their first ``depth`` bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, depth: int):
        self.data, self.starts, self.depth = data, starts, depth
        self.sums, self.down = prefix_hashes(data), powers(len(data) + 1)[1]

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``a`` and ``b``, at most ``depth``: binary search for the longest
        prefix with equal hashes."""
        out = np.full(len(a), self.depth, np.int64)
        differ = np.flatnonzero(self.hashes(a, self.depth) != self.hashes(b, self.depth))
        for i in range(0, len(differ), PAIRS):
            at = differ[i:i + PAIRS]
            out[at] = self._common(a[at], b[at])
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`common` of suffixes whose hashes differ."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.depth, np.int64)  # equal to low, unequal at high
        with np.errstate(over="ignore"):
            # what a hash takes at the start of a suffix is read once, not at each halving
            before_a, before_b, down_a, down_b = self.sums[a], self.sums[b], self.down[a], self.down[b]
            while len(a) and (high - low).max() > 1:
                mid = (low + high) >> 1
                same = (self.sums[a + mid] - before_a) * down_a == (self.sums[b + mid] - before_b) * down_b
                low, high = np.where(same, mid, low), np.where(same, high, mid)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` sorts before ``b`` (or equal, where asked)."""
        size = self.common(a, b)
        inside = size < self.depth
        at = np.where(inside, size, 0)
        return np.where(inside, self.data[a + at] < self.data[b + at], or_equal)

    def sort(self, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes that sorts each segment (ascending, contiguous ids) by suffix.

        Suffixes of a segment whose hashes agree stand together, so only the first of each is sorted and the others follow
        it: a passage that many documents share costs one suffix, whatever their number.
        """
        if not len(self.starts):
            return np.arange(0)
        heads = self.hashes(self.starts, self.depth)
        by = np.lexsort((heads, segment))
        new = np.flatnonzero(np.r_[True, (heads[by][1:] != heads[by][:-1]) | (segment[by][1:] != segment[by][:-1])])
        size = np.diff(np.r_[new, len(by)])
        order = self._merged(self.starts[by[new]], segment[by[new]])
        size, lead = size[order], new[order]
        return by[np.repeat(lead - np.cumsum(size) + size, size) + np.arange(len(by))]

    def _merged(self, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """:meth:`sort` of suffixes at ``starts`` that differ.

        All runs of all segments double together: each element's place in the merged run is its place in its own run plus
        its rank in the sibling run, found by binary search with suffix comparisons.
        """
        n = len(starts)
        order = np.arange(n)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[first, n])
        lo_of, size_of = np.repeat(first, size), np.repeat(size, size)
        run = 1
        while run < size.max():
            act = np.flatnonzero(size_of > run)  # positions in segments with more than one run left
            lo, seg = lo_of[act], size_of[act]
            place = act - lo
            mine = place // run
            pair = (mine & ~1) * run
            right = (mine & 1).astype(bool)
            sib_lo = np.where(right, pair, pair + run)
            sib_hi = np.minimum(sib_lo + run, seg)
            sib_lo = np.minimum(sib_lo, sib_hi)
            own = starts[order[act]]
            a, b = sib_lo.copy(), sib_hi.copy()
            while True:
                todo = np.flatnonzero(a < b)
                if not len(todo):
                    break
                mid = (a[todo] + b[todo]) >> 1
                other = starts[order[lo[todo] + mid]]
                # a sibling element counts as before: strictly for left elements, or equal for right ones (stable)
                counts = self.before(other, own[todo], right[todo])
                a[todo] = np.where(counts, mid + 1, a[todo])
                b[todo] = np.where(counts, b[todo], mid)
            new = lo + pair + (place - mine * run) + (a - sib_lo)
            moved = order.copy()
            moved[new] = order[act]
            order = moved
            run *= 2
        return order

    def equal_runs(self, order: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Id of the run of equal suffixes (first ``depth`` bytes, same segment) at each place of ``order``.

        Neighbours whose hashes agree are compared byte by byte; a segment where they differ after all is sorted again by
        its bytes, so a collision cannot join or part anything.
        """
        s, seg = self.starts[order], segment[order]
        near = np.flatnonzero((seg[1:] == seg[:-1]) & (self.hashes(s[1:], self.depth) == self.hashes(s[:-1], self.depth)))
        joined = np.zeros(len(s), bool)
        joined[near + 1] = True
        wrong = np.zeros(len(near), bool)
        for k in range(self.depth):
            wrong |= self.data[s[near] + k] != self.data[s[near + 1] + k]
        for g in np.unique(seg[near[wrong]]):
            at = np.flatnonzero(seg == g)
            heads = np.array([self.data[x:x + self.depth].tobytes() for x in s[at]])
            by = np.argsort(heads, kind="stable")
            order[at] = order[at][by]
            joined[at] = np.r_[False, heads[by][1:] == heads[by][:-1]]
        return np.cumsum(~joined) - 1
