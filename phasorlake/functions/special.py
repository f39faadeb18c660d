"""Numerical helpers that run on the driver, over a handful of numbers."""

from __future__ import annotations

import math

import numpy as np


def log_sphere(p: int, is_complex: bool) -> float:
    """ln of 1 / area of the unit sphere of R^p or C^p, for densities on lines."""
    c = p if is_complex else p / 2
    return math.lgamma(c) - math.log(2) - c * math.log(math.pi)


def log_kummer(a: float, c: float, x: float, tol: float = 1e-13) -> float:
    """ln 1F1(a; c; x). For x < 0 by 1F1(a;c;x) = e^x 1F1(c-a;c;-x), so all terms are positive."""
    if x < 0:
        return x + log_kummer(c - a, c, -x, tol)
    if x == 0:
        return 0.0
    last, top, total, at, size = 0.0, 0.0, 1.0, 0, 256
    while True:
        j = np.arange(at, at + size, dtype=float)
        step = np.log((a + j) / (c + j) * x / (j + 1))
        term = last + np.cumsum(step)
        high = max(top, float(term.max()))
        total = total * math.exp(top - high) + float(np.exp(term - high).sum())
        last, top, at, size = float(term[-1]), high, at + size, min(size * 2, 1 << 20)
        if step[-1] < 0 and last - top - math.log(total) < math.log(tol) or at > 10_000_000:
            return top + math.log(total)


def kummer_ratio(a: float, c: float, x: float) -> float:
    """d/dx ln 1F1(a; c; x): rises from 0 to 1 over the real line, a / c at 0."""
    return a / c * math.exp(log_kummer(a + 1, c + 1, x) - log_kummer(a, c, x))


def solve_kummer(a: float, c: float, r: float, tol: float = 1e-10) -> float:
    """The x at which kummer_ratio is r, by Newton's steps inside known bounds, or bisection where one leaves them.
    The ratio g has the slope (1 - c / x) g + a / x - g^2."""
    r = min(max(r, 1e-9), 1 - 1e-9)
    if abs(r - a / c) < 1e-14:
        return 0.0
    base = (r * c - a) / (r * (1 - r))
    sides = (base * (1 + (1 - r) / (c - a)), base / 2 * (1 + math.sqrt(1 + 4 * (c + 1) * r * (1 - r) / (a * (c - a)))), base * (1 + r / a))
    low, high = min(sides), max(sides)
    while kummer_ratio(a, c, low) > r:
        low -= abs(low) + 1
    while kummer_ratio(a, c, high) < r:
        high += abs(high) + 1
    x = (low + high) / 2
    while high - low > tol * max(1.0, abs(low), abs(high)):
        g = kummer_ratio(a, c, x)
        low, high = (x, high) if g < r else (low, x)
        slope = (1 - c / x) * g + a / x - g * g if x else 0.0
        new = x - (g - r) / slope if slope > 0 else low
        if not low < new < high:
            new = (low + high) / 2
        if abs(new - x) <= tol / 4 * max(1.0, abs(x)):
            return new
        x = new
    return x


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest one-to-one assignment: shortest augmenting paths with
    potentials, a row at a time."""
    n, m = cost.shape
    if n > m:
        back = assignment(cost.T)
        out = np.full(n, -1)
        out[back] = np.arange(m)
        return out
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for row in range(n):
        owner[m] = row
        slack, previous, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        j = m
        while owner[j] != n:
            done[j] = True
            i = owner[j]
            free = ~done[:m]
            reduced = cost[i] - u[i] - v[:m]
            better = free & (reduced < slack)
            slack[better], previous[better] = reduced[better], j
            nxt = int(np.flatnonzero(free)[slack[free].argmin()])
            delta = slack[nxt]
            u[owner[done]] += delta
            v[np.flatnonzero(done)] -= delta
            slack[free] -= delta
            j = nxt
        while j != m:
            owner[j] = owner[previous[j]]
            j = previous[j]
        owner[m] = n
    out = np.full(n, -1)
    for j in range(m):
        if owner[j] != n:
            out[owner[j]] = j
    return out


def signed_rank_two_sided(n: int, w: float) -> float:
    """P of a smaller sum of n signed ranks of at most ``w`` when signs are by chance: of the 2^n choices of ranks, how
    many have which sum, one rank after the other, in whole numbers."""
    ways = [1]
    for rank in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if s >= rank else 0) for s in range(len(ways) + rank)]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / (1 << n))
