"""Tails of the distributions that tests use, for single values: binomial, Student's t, signed ranks, normal. Callers map them over summaries."""

from __future__ import annotations

import math
from functools import lru_cache

_TINY = 1e-300


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):  # where the fraction of the other side converges faster
        return 1.0 - beta_share(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + step / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws with chance p each."""
    if k >= n:
        return 1.0
    return 0.0 if k < 0 else beta_share(n - k, k + 1, 1.0 - p)


def binomial_upper(k: int, n: int, alpha: float) -> float:
    """The largest chance that k of n or fewer do not contradict at level alpha: the exact upper confidence bound."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if binomial_at_most(k, n, middle) > alpha else (low, middle)
    return high


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def student_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=64)
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    """How many of the 2^n choices of signs give each sum of the ranks 1 to n."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(counts) - 1, rank - 1, -1):
            counts[s] += counts[s - rank]
    return tuple(counts)


def signed_rank_two_sided(w: float, n: int) -> float:
    """Twice P(W <= w) of the smaller rank sum of n differences without ties, 1 at most."""
    return min(1.0, 2 * sum(_signed_rank_counts(n)[: math.floor(w) + 1]) / 2**n)
