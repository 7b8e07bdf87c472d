"""Scalar and array functions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 1e-6

#: The coefficients of Abramowitz and Stegun 7.1.26, an error function good to 1.5e-7.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(0.0)


def entropy(weights: Column) -> Column:
    """Bits of a distribution given as an array of weights; 0 for an empty one."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.log2(total) - F.aggregate(weights, F.lit(0.0), lambda s, v: s + F.when(v > 0, v * F.log2(v)).otherwise(0.0)) / total).otherwise(0.0)


def total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda s, v: s + v)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, in arithmetic that any SQL engine has."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = t * (ERF_A[0] + t * (ERF_A[1] + t * (ERF_A[2] + t * (ERF_A[3] + t * ERF_A[4]))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z < 0, half).otherwise(1 - half)


def normal_cdf_sql(z: str) -> str:
    """The same arithmetic as SQL text."""
    x = f"(abs({z})/{math.sqrt(2)!r})"
    t = f"(1/(1+{ERF_P}*{x}))"
    poly = f"{t}*({ERF_A[0]}+{t}*({ERF_A[1]}+{t}*({ERF_A[2]}+{t}*({ERF_A[3]}+{t}*{ERF_A[4]}))))"
    return f"(case when {z} < 0 then 0.5*{poly}*exp(-{x}*{x}) else 1-0.5*{poly}*exp(-{x}*{x}) end)"


def gaussian_pdf(x: Column, mean: Column, sd: Column) -> Column:
    """Density; a distribution without spread is 1 at its mean and 0 elsewhere."""
    z = (x - mean) / sd
    return F.when(sd > 0, F.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * sd)).otherwise(F.when(x == mean, 1.0).otherwise(0.0))


def max_index(values: Column) -> Column:
    """Index of the first largest value; 0 for an empty array."""
    return F.coalesce(F.array_position(values, F.array_max(values)) - 1, F.lit(0)).cast("int")


def min_index(values: Column) -> Column:
    return F.coalesce(F.array_position(values, F.array_min(values)) - 1, F.lit(0)).cast("int")


def normalize(values: Column) -> Column:
    """Shares of the sum; null where the sum is 0."""
    return F.when(total(values) != 0, F.transform(values, lambda v: v / total(values)))


def logs2probs(logs: Column) -> Column:
    """Probabilities from log weights, shifted by the largest for safety."""
    top = F.array_max(logs)
    return normalize(F.transform(logs, lambda v: F.exp(v - top)))


def log_odds(p: Column) -> Column:
    squeezed = F.greatest(F.least(p, F.lit(1 - SMALL)), F.lit(SMALL))
    return F.log(squeezed / (1 - squeezed))


def kth_smallest(values: Column, k: int) -> Column:
    return F.get(F.array_sort(values), k - 1)


def about_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) < SMALL


def greater(a: Column, b: Column) -> Column:
    return a - b > SMALL


def smaller(a: Column, b: Column) -> Column:
    return b - a > SMALL


def hash_uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("double") / 4294967296.0


def prob_round(v: Column, u: Column) -> Column:
    """A whole number next to v: the upper one with the probability of v's fraction, for a uniform number u."""
    return (F.floor(v) + (v - F.floor(v) > u).cast("int")).cast("long")


def poisson1(u: Column) -> Column:
    """Poisson(1) by inversion: the smallest k whose cumulated weight exceeds u * e; a tie advances."""
    steps, sums = [], 0.0
    for k in range(12):
        sums += 1 / math.factorial(k)
        steps.append((k, sums / math.e))
    out = F.lit(12)
    for k, bar in reversed(steps):
        out = F.when(u < bar, k).otherwise(out)
    return out.cast("int")


def poisson1_sql(u: str) -> str:
    out, sums = [], 0.0
    for k in range(12):
        sums += 1 / math.factorial(k)
        out.append(f"when {u} < {sums / math.e!r} then {k}")
    return f"(case {' '.join(out)} else 12 end)"


def decayed(rate: float, now: Column, ts: Column) -> Column:
    return F.pow(F.lit(2.0), -rate * (now - ts))


def hoeffding_bound(value_range: Column, delta: float, n: Column) -> Column:
    return F.sqrt(value_range * value_range * math.log(1 / delta) / (2 * n))
