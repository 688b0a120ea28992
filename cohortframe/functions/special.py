"""Tail probabilities in numpy and the standard library."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    f = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(table: tuple[int, int, int, int]) -> tuple[np.ndarray, int]:
    """The probabilities of all tables [[a, b], [c, d]] with the given margins, and the place of the given one."""
    a, b, c, d = (int(x) for x in table)
    n, row, col = a + b + c + d, a + b, a + c
    low, high = max(0, row + col - n), min(row, col)
    k = np.arange(low, high + 1)
    base = _log_choose(n, row)
    p = np.exp([_log_choose(col, int(x)) + _log_choose(n - col, row - int(x)) - base for x in k])
    return p, a - low


def fisher_exact(table: tuple[int, int, int, int], alternative: str = "two-sided") -> float:
    """Fisher's exact p of [[a, b], [c, d]].

    Two-sided: the tables no likelier than the given one, within a relative tolerance of 1e-7.
    """
    p, at = hypergeometric(table)
    if alternative == "greater":
        return float(min(1.0, p[at:].sum()))
    if alternative == "less":
        return float(min(1.0, p[: at + 1].sum()))
    return float(min(1.0, p[p <= p[at] * (1 + 1e-7)].sum()))


def fisher_mid(table: tuple[int, int, int, int]) -> float:
    """The exact two-sided p less half the probability of the given table."""
    p, at = hypergeometric(table)
    return float(np.clip(fisher_exact(table) - 0.5 * p[at], 0.0, 1.0))


def signed_rank(differences: list[float]) -> float:
    """Two-sided Wilcoxon signed-rank p; zeros are left out.

    Exact for up to 25 differences without ties, else the normal approximation with tie correction.
    """
    x = np.array([d for d in differences if d != 0], float)
    n = len(x)
    if not n:
        return 1.0
    size = np.abs(x)
    order = np.argsort(size, kind="stable")
    rank = np.empty(n)
    values, start, count = np.unique(size[order], return_index=True, return_counts=True)
    rank[order] = np.repeat(start + (count + 1) / 2, count)
    up = rank[x > 0].sum()
    low = min(up, n * (n + 1) / 2 - up)
    if n <= 25 and count.max() == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (count**3 - count).sum() / 48)
    return float(min(1.0, math.erfc(abs(low - n * (n + 1) / 4) / sd / math.sqrt(2)))) if sd else 1.0
