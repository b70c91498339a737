"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induced sorting fills one bucket after the other, and what a bucket's suffixes induce can be dealt out all at once:
only suffixes that begin with a run of the bucket's own symbol wait for another turn. So the linear scans cost a few
array operations a symbol of the alphabet, whatever the length of the text.
"""

from __future__ import annotations

import numpy as np

#: Alphabets beyond this have more buckets than suffixes worth a turn each; their suffixes are ranked by doubling.
MOST_SYMBOLS = 512


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the text is smaller than anything."""
    step = np.empty(len(t), np.int8)
    step[-1] = -1
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    known = np.where(step != 0, np.arange(len(t)), len(t))
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


class _Buckets:
    """Places of a suffix array, filled from one end of each bucket."""

    def __init__(self, sa: np.ndarray, edge: np.ndarray, way: int) -> None:
        self.sa, self.edge, self.way = sa, edge, way
        self.used = np.zeros(len(edge), np.int64)

    def put(self, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        """Appends the suffixes, in this order, to the buckets of their first symbols."""
        order = np.argsort(symbols, kind="stable")
        kind = symbols[order]
        count = np.bincount(kind, minlength=len(self.used))
        rank = np.arange(len(kind)) - (np.cumsum(count) - count)[kind]
        self.sa[self.edge[kind] + self.way * (self.used[kind] + rank)] = suffixes[order]
        self.used += count

    def filled(self, c: int, since: int = 0) -> np.ndarray:
        a, b = self.edge[c] + self.way * since, self.edge[c] + self.way * self.used[c]
        return self.sa[a:b] if self.way > 0 else self.sa[b + 1 : a + 1][::-1]


def _induce(t: np.ndarray, rising: np.ndarray, size: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost rising suffixes ``lms``."""
    n = len(t)
    start, sa = np.cumsum(size) - size, np.full(n, -1, np.int64)
    falling, growing = _Buckets(sa, start, 1), _Buckets(sa, start + size - 1, -1)
    by_symbol = t[lms]
    order = np.argsort(by_symbol, kind="stable")
    seeds = np.split(lms[order], np.cumsum(np.bincount(by_symbol, minlength=len(size)))[:-1])
    symbols = np.flatnonzero(size)

    def before(found: np.ndarray, want: bool) -> np.ndarray:
        j = found[found > 0] - 1
        return j[rising[j] == want]

    falling.put(np.array([n - 1]), t[n - 1 :])  # what the end of the text induces
    for c in symbols:
        done = 0
        while done < falling.used[c]:
            done, now = falling.used[c], falling.filled(c, done)
            j = before(now, False)
            falling.put(j, t[j])
        j = before(seeds[c], False)
        falling.put(j, t[j])
    for c in symbols[::-1]:
        done = 0
        while done < growing.used[c]:
            done, now = growing.used[c], growing.filled(c, done)
            j = before(now, True)
            growing.put(j, t[j])
        j = before(falling.filled(c)[::-1], True)
        growing.put(j, t[j])
    return sa


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the substrings of equal ``size`` at a and b are equal."""
    out = np.zeros(len(a), bool)
    left, k = np.arange(len(a)), 0
    while len(left):
        over = size[left] <= k
        out[left[over]] = True
        left = left[~over]
        left = left[t[a[left] + k] == t[b[left] + k]]
        k += 1
    return out


def _by_doubling(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array from ranks of prefixes of doubling length, until these tell all suffixes apart or reach ``depth``."""
    n, h = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        sa = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[sa][1:] != key[sa][:-1])))
        rank = np.empty(n, np.int64)
        rank[sa] = new
        if new[-1] == n - 1:
            return sa
        h *= 2
        if h >= min(n, depth):
            return sa


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes of a text of small non-negative numbers, in order.

    With ``depth``, suffixes that share that many first symbols may stand in any order among themselves.
    """
    n = len(t)
    depth = n if depth is None else depth
    if n < 2:
        return np.arange(n)
    sigma = int(t.max()) + 1
    if sigma > MOST_SYMBOLS:
        return _by_doubling(t, depth)
    rising = _types(t)
    size = np.bincount(t, minlength=sigma)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, rising, size, lms)
    first = _induce(t, rising, size, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = n - lms[-1]
    a, b = ordered[:-1], ordered[1:]
    equal = np.zeros(len(a), bool)
    may = np.flatnonzero((length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1]))
    equal[may] = _same(t, a[may], b[may], length[a[may]])
    name = np.empty(n, np.int64)
    name[ordered] = np.concatenate(([0], np.cumsum(~equal)))
    names = name[lms]
    if names.max() + 1 < len(lms):
        ordered = lms[suffix_array(names, depth // 2 + 2)]
    return _induce(t, rising, size, ordered)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int, lane: int = 128) -> np.ndarray:
    """For each start of a suffix, the length, at most ``most``, of the prefix it shares with the one before it in order.

    Going from one start to the next loses one symbol of that prefix at most, so lengths are carried along the text;
    stretches of ``lane`` starts are worked on side by side. The order need be exact to ``most`` symbols only: suffixes
    that share as many stand in any order, so from a length of ``most`` nothing is carried to another neighbour.
    """
    n = len(t)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    prior = np.empty(n, np.int64)
    prior[sa[0]] = -1
    prior[sa[1:]] = sa[:-1]
    begin = np.arange(0, n, lane)
    held, beside = np.zeros(len(begin), np.int64), np.full(len(begin), -1)
    for s in range(lane):
        p = begin + s
        live = np.flatnonzero(p < n)
        p, q = p[live], prior[p[live]]
        carried = (q >= 0) & ((held[live] < most) | (q == beside[live] + 1))
        size = np.where(carried, np.maximum(held[live] - 1, 0), 0)
        left = np.flatnonzero(q >= 0)
        while len(left):
            x, y = p[left] + size[left], q[left] + size[left]
            left = left[(size[left] < most) & (x < n) & (y < n)]
            x, y = p[left] + size[left], q[left] + size[left]
            left = left[t[x] == t[y]]
            size[left] += 1
        out[p] = size
        held[live], beside[live] = size, q
    return out
