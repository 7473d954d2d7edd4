"""Quantiles and tail probabilities that inference needs."""

from __future__ import annotations

import math
from statistics import NormalDist

z_quantile = NormalDist().inv_cdf


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom > x): the regularised upper gamma function at (df/2, x/2)."""
    if x <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # the series of the lower function
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300  # the continued fraction of the upper one
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
