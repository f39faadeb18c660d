"""Suffix arrays by induced sorting, and permuted common prefixes, of one block of symbols.

Suffixes are of type S (smaller than the next one) or L. The S suffixes after an L one (leftmost-smaller,
LMS) begin substrings that reach to the next such place; these are named in order, and where names repeat,
the string of names is sorted the same way first. From sorted LMS suffixes all L suffixes follow in one scan
of the order from the left, all S suffixes in one from the right.

A scan takes stretches of the order as arrays: up to the first place that the stretch itself fills.
"""

from __future__ import annotations

import numpy as np

#: A stretch that ends sooner gives way to the next ONE_BY_ONE suffixes taken singly.
SHORT, ONE_BY_ONE = 96, 512


def types_of(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last symbol, smaller than all others, is."""
    s = np.ones(len(t), bool)
    differs = np.flatnonzero(t[:-1] != t[1:])
    s[:-1] = np.repeat(t[differs] < t[differs + 1], np.diff(np.concatenate(([-1], differs))))
    return s


def _runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    new = np.empty(len(c), bool)
    new[:1] = True
    np.not_equal(c[1:], c[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(c)))


def _scan(t: np.ndarray, wanted: np.ndarray, sa: np.ndarray, place: np.ndarray) -> None:
    """Each suffix in order puts the one before it, where that is wanted, at its symbol's next place."""
    n, p, size = len(sa), 0, 256
    while p < n:
        if size < SHORT:
            for p in range(p, min(p + ONE_BY_ONE, n)):
                j = sa.item(p) - 1
                if j >= 0 and wanted.item(j):
                    c = t.item(j)
                    to = place.item(c)
                    sa[to] = j
                    place[c] = to + 1
            p, size = p + 1, 256
            continue
        q = min(p + size, n)
        at = np.flatnonzero(sa[p:q] > 0)
        before = sa[p:q][at] - 1
        ok = np.flatnonzero(wanted[before])
        if not len(ok):
            p, size = q, size * 2
            continue
        m, at, before = len(ok), at[ok], before[ok]
        c, order = np.divmod(np.sort(t[before] * m + np.arange(m)), m)
        first, count = _runs(c)
        to = np.arange(m) + np.repeat(place[c[first]] - first, count)
        least = int(to.min())
        if least < q:  # from there on the stretch wasn't complete when it was read
            inside = np.flatnonzero(at[order] < least - p)
            order, c, to = order[inside], c[inside], to[inside]
            first, count = _runs(c)
            q, size = least, 2 * (least - p)
        else:
            size *= 2
        sa[to] = before[order]
        place[c[first]] += count
        p = q


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the LMS ones in order."""
    n = len(t)
    sizes = np.bincount(t, minlength=symbols)
    ends = np.cumsum(sizes)
    sa = np.full(n, -1, np.int64)
    order = np.argsort(t[lms], kind="stable")
    c = t[lms][order]
    seeds = np.bincount(c, minlength=symbols)
    sa[(ends - np.cumsum(seeds))[c] + np.arange(len(c))] = lms[order]
    _scan(t, ~s, sa, ends - sizes)
    back = sa[::-1].copy()
    back[(back >= 0) & s[back]] = -1
    back[-1] = n - 1
    _scan(t, s, back, n - ends)
    back[-1] = n - 1
    return back[::-1]


def _ranks(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """For each LMS substring the number of smaller ones. As many symbols as fit in 63 bits are compared at
    once; where one substring ends inside another it is the larger, as an S suffix follows L ones."""
    length = np.append(np.diff(lms), 0) + 1
    bits = int(t.max() + 1).bit_length()
    each, end = 63 // bits, (1 << bits) - 1
    rank, open_, k = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(open_):
        key = np.zeros(len(open_), np.int64)
        for j in range(k, k + each):
            key = key << bits | np.where(j < length[open_], t[np.minimum(lms[open_] + j, len(t) - 1)], end)
        order = np.lexsort((key, rank[open_])) if k else np.argsort(key)
        of, key, open_ = rank[open_][order], key[order], open_[order]
        group = np.concatenate(([True], of[1:] != of[:-1]))
        new = group | np.concatenate(([True], key[1:] != key[:-1]))
        at = np.arange(len(open_))
        begin = lambda flag: np.maximum.accumulate(np.where(flag, at, 0))
        rank[open_] = of + begin(new) - begin(group)
        k += each
        tied = ~new | np.append(~new[1:], False)
        open_ = open_[tied & (length[open_] >= k)]
    return rank


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """The starts of all suffixes in order. ``t`` ends in its only 0 and has values below ``symbols``."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    s = types_of(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    rank = _ranks(t, lms)
    order = np.argsort(rank, kind="stable")
    first, count = _runs(rank[order])
    if len(first) < len(lms):
        names = np.empty(len(lms), np.int64)
        names[order] = np.repeat(np.arange(len(first)), count)
        order = suffix_array(names, len(first))
    return _induce(t, s, lms[order], symbols)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length that its suffix shares with the one before it in the order.

    In text order the lengths fall by at most one, and by just one where the symbols before both suffixes
    are equal; only the other ones are compared symbol by symbol, all at once."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    plain = (at > 0) & (phi > 0)
    plain[plain] = t[at[plain] - 1] == t[phi[plain] - 1]
    left = np.flatnonzero((phi >= 0) & ~plain)
    other = phi[left]
    length = np.zeros(n, np.int64)
    k = 0
    while len(left):
        inside = np.flatnonzero(np.maximum(left, other) + k < n)
        left, other = left[inside], other[inside]
        same = np.flatnonzero(t[left + k] == t[other + k])
        left, other = left[same], other[same]
        k += 1
        length[left] = k
    known = np.where(plain, -1, at + length)
    return np.maximum(np.maximum.accumulate(known) - at, 0) * (phi >= 0)
