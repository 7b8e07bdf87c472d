"""Distribution functions for the driver: gamma and beta integrals, chi squared, F, normal, errors of shares."""

from __future__ import annotations

import math
from statistics import NormalDist


def incomplete_gamma(a: float, x: float) -> float:
    """Lower regularised incomplete gamma function: its series, or the continued fraction of the rest."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(front * total, 1.0)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + an * d) or 1e-300)
            c = (1 + an / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_squared(x: float, freedom: float) -> float:
    """Probability of a value of at least x."""
    return 1 - incomplete_gamma(freedom / 2, x / 2)


def f_probability(f: float, d1: float, d2: float) -> float:
    """Probability of a ratio of at least f."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_probability(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_inverse(p: float) -> float:
    return NormalDist().inv_cdf(p)


def binomial_standard_error(p: float, n: int) -> float:
    return math.sqrt(p * (1 - p) / n) if n else 0.0
