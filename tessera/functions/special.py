"""Distribution functions without scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()
ppf, pdf = _N.inv_cdf, _N.pdf


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of a chi-square with 1 or 2 degrees of freedom."""
    x = max(x, 0.0)
    return math.erfc(math.sqrt(x / 2)) if df == 1 else math.exp(-x / 2)


def binom_cdf(k: int, n: int, p: float) -> float:
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def xlogy(x: float, y: float) -> float:
    return 0.0 if x == 0 else x * math.log(y)


def cornish_fisher(z: float, skew: float, kurt: float) -> float:
    """The normal quantile z, corrected for skewness and excess kurtosis."""
    return z + (z * z - 1) * skew / 6 + (z**3 - 3 * z) * kurt / 24 - (2 * z**3 - 5 * z) * skew * skew / 36
