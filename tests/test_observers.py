import math

import numpy as np
import pytest

from tidemark.functions import distributions as P
from tidemark.operators import observers as O


def test_bins_are_exact_while_values_fit():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 8, 300), rng.integers(0, 3, 300)
    b = O.Bins(3)
    for v, c in zip(x, y):
        b.add(float(v), int(c))
    b.add(float("nan"), 0)
    for cut, left, right in b.cuts():
        assert list(left) == [((x <= cut) & (y == c)).sum() for c in range(3)]
        assert left.sum() + right.sum() == 300
    assert len(b.cuts()) == 7


def test_bins_keep_all_weight_beyond_the_limit():
    b = O.Bins(2, limit=4)
    for i in range(100):
        b.add(float((i * 37) % 100), i % 2)
    assert len(b.low) == 4 and all(left.sum() + right.sum() == 100 for _, left, right in b.cuts())


def test_quantile_summary():
    q = O.Quantiles(limit=40)
    for v in np.random.default_rng(1).permutation(2000):
        q.add(float(v))
    assert len(q.tuples) <= 40 and q.n == 2000
    assert q.quantile(0) == 0 and q.quantile(1) == 1999 and q.error() < 300
    assert abs(q.quantile(0.5) - 1000) < 150 and abs(q.below(500.0) - 500) < 150
    assert O.Quantiles().quantile(0.5) is None


def test_limited_moments():
    m = O.LimitedMoments(limit=5)
    rows = [(float(v), float(v * v)) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    for x, y in rows:
        m.add(x, y)
    for x, left, right in m.cuts():
        kept = [y for v, y in rows if v <= x]
        assert left[0] == len(kept) and left[1] == sum(kept) and left[0] + right[0] == len(rows)


def test_summaries_by_key(spark):
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(90)], "k long, i long, x double")
    got = {r.k: (r.n, r.lower <= r.median <= r.upper) for r in O.summarised(df, "k", "i", "x").collect()}
    assert got == {0: (30, True), 1: (30, True), 2: (30, True)}


def test_perturbed_clusterings():
    made = [{"centre": [0.1 * k, 0.5], "radius": 0.02, "weight": 4.0} for k in range(1, 9)]
    assert [list(c["centre"]) for c in O.perturbed(made)] == [pytest.approx(c["centre"]) for c in made]
    assert O.perturbed(made, remove=1.0) == [] and len(O.perturbed(made, extra=2)) == 10
    moved = O.perturbed(made, shift=3.0)
    assert all(0 <= v <= 1 for c in moved for v in c["centre"]) and made[0]["centre"] == [0.1, 0.5]
    one = O.perturbed(made, join=100.0)
    assert len(one) == 1 and one[0]["weight"] == 32


def test_class_indexes():
    assert O.class_indexes([7, -1, 3, 7]) == {7: 0, 3: 1, -1: 2}


def test_distributions():
    assert P.chi_squared(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert P.f_probability(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert P.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and P.incomplete_gamma(1, 2) == pytest.approx(1 - math.exp(-2))
    assert P.normal_inverse(P.normal_probability(0.7)) == pytest.approx(0.7)
    assert P.binomial_standard_error(0.5, 100) == 0.05
