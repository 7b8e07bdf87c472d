"""Mergeable quantile summaries: bounds hold and the error is bounded, however the rows are dealt."""

import numpy as np
import pytest

from tidemark.operators import summaries
from tidemark.operators.hoeffding import info_gain
from tidemark.operators.summaries import Summary


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_through_merging_and_pruning(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.choice([rng.normal(size=n), rng.integers(0, 30, n).astype(float)][int(seed % 2)], n) for n in rng.integers(1, 3000, 9)]
    size, held = 50, []
    for p in parts:
        held.append(Summary.of(p).pruned(size))
    while len(held) > 1:
        held = [held[k].merged(held[k + 1]).pruned(size) if k + 1 < len(held) else held[k] for k in range(0, len(held), 2)]
    every, s = np.concatenate(parts), held[0]
    x = np.concatenate([rng.choice(every, 200), rng.normal(size=100) * 3])
    want = (every[None, :] <= x[:, None]).sum(1)
    low, high = s.bounds(x)
    assert (low <= want).all() and (want <= high).all() and s.rows == len(every) and len(s.values) <= size + 1
    assert np.abs(s.below(x) - want).max() <= s.error() + 1e-9
    assert s.error() <= 5 * len(every) / (2 * size) + 1
    if seed % 2:  # few values are counted exactly
        assert s.error() == 0 and (s.below(x) == want).all()


def test_empty_and_single():
    s = Summary.of(np.array([]))
    assert s.rows == 0 and s.merged(Summary.of(np.array([2.0, 2.0]))).rows == 2
    one = Summary.of(np.array([2.0]))
    assert one.below(np.array([1.0, 2.0, 3.0])).tolist() == [0, 1, 1] and one.quantiles(np.array([0.5])).tolist() == [2.0]


@pytest.mark.parametrize("parts, fan_in", [(1, 32), (4, 32), (16, 2)])
def test_class_cuts_are_near_the_exact_ones(spark, parts, fan_in):
    rng = np.random.default_rng(7)
    x, c = rng.normal(size=6000), rng.integers(0, 3, 6000)
    x = x + (c == 2) * 1.5
    rows = [(float(v), None if i % 50 == 0 else float(v > 0), None if i % 97 == 0 else f"k{k}") for i, (v, k) in enumerate(zip(x, c))] + [(float("nan"), 1.0, "k0")]
    df = spark.createDataFrame(rows, "x double, z double, y string").repartition(parts).selectExpr("*", "'a' as class", "1 as part", "2 as v")
    found = summaries.summarised(df, ["x", "z"], "y", size=100, fan_in=fan_in)
    every = {k: np.array([v for v, _, y in rows if y == k and v == v]) for k in ("k0", "k1", "k2")}
    for r in found.where("attribute = 'x'").collect():
        s = summaries._read([r.asDict()])[0]
        assert s.rows == len(every[r["class"]]) and s.error() <= s.rows / 100 + 1
    assert found.count() == 6
    cuts = summaries.class_cuts(found, 20)
    for r in cuts.where("attribute = 'x'").collect():
        assert abs(r.below - (every[r["class"]] <= r.cut).sum()) <= len(every[r["class"]]) / 100 + 1
    best = summaries.best_cuts(cuts)["x"][1]
    classes = sorted(every)
    exact = max(info_gain(np.array([len(every[k]) for k in classes]), [np.array([(every[k] <= t).sum() for k in classes]), np.array([(every[k] > t).sum() for k in classes])]) for t in np.unique(x))
    assert abs(exact - best) < 0.01
