"""Balls by core-sets and merged spheres, against the smallest ball of all points and all pairs."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import spheres
from tidemark.operators.micro import enclosing


def cloud(seed, n, dims, groups):
    rng = np.random.default_rng(seed)
    return [(int(k), (rng.normal(size=dims) + 4 * k).tolist()) for k in rng.integers(0, groups, n)]


@pytest.mark.parametrize("dims, gap", [(2, 1e-3), (9, 1e-4)])
def test_balls_are_as_small_as_they_can_be(spark, dims, gap):
    rows = cloud(3, 500, dims, 3) + [(7, [1.0] * dims), (8, [2.0] * dims), (8, [2.0] * dims), (None, [0.0] * dims), (9, None)]
    df = spark.createDataFrame(rows, "k int, x array<double>").repartition(5).selectExpr("*", "'a' as key", "1 as centre")
    got = {r.k: r for r in spheres.balls(df, "k", gap).collect()}
    assert sorted(got) == [0, 1, 2, 7, 8]
    for k, r in got.items():
        x = np.array([p for g, p in rows if g == k])
        _, want = enclosing(x)
        far = np.sqrt(((x - np.array(r.centre)) ** 2).sum(1).max())
        assert r.n == len(x) and r.radius == pytest.approx(far) and r.least <= want + 1e-9 <= r.radius + 1e-6 and r.radius <= r.least * (1 + gap) + 1e-12
    assert got[7].radius == 0 and got[8].radius == 0
    assert spheres.balls(df.where("false"), "k").collect() == []


def test_separation_about_the_middles_of_balls(spark):
    rows = cloud(5, 300, 3, 2)
    df = spark.createDataFrame(rows, "k int, x array<double>")
    of = [{"centre": [0.0, 0.0, 0.0], "weight": 2.0}, {"centre": [4.0, 4.0, 4.0], "weight": 3.0}]
    got = spheres.separation_of(df, of, of, 1e-5)
    middle, _ = enclosing(np.array([p for _, p in rows]))
    want = sum(c["weight"] * ((np.array(c["centre"]) - middle) ** 2).sum() for c in of)
    assert got["bss"] == pytest.approx(want, rel=1e-3) and got["bss_gt"] == pytest.approx(5 * 12.0, rel=1e-6) and got["bss_ratio"] == pytest.approx(got["bss"] / got["bss_gt"])
    assert spheres.separation_of(df.where("false"), of, of)["bss"] is None


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.9])
def test_merged_spheres_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(11)
    made = [(k, [rng.random() * 12, rng.random() * 12, rng.random()], rng.choice([0.0, 0.3, 0.6, 1.0]), 1.0 + k % 3) for k in range(120)] + [(200, [3.0, 3.0, 0.5], 0.0, 1.0), (201, [3.0, 3.0, 0.5], 0.0, 1.0), (202, [-9.0, -9.0, 0.0], 0.1, 5.0)]
    df = spark.createDataFrame(made, "cluster int, centre array<double>, radius double, weight double")

    def over(a, b):
        d, (small, large) = math.dist(a[1], b[1]), sorted((a[2], b[2]))
        return 0.0 if d >= a[2] + b[2] else 1.0 if d + small <= large else (a[2] + b[2] - d) / (2 * small)

    want = {(a[0], b[0]) for a in made for b in made if a[0] < b[0] and over(a, b) > threshold}
    assert {(r.a, r.b) for r in spheres.overlapping(df, threshold).collect()} == want and want
    name = {m[0]: m[0] for m in made}
    for _ in made:
        for a, b in want:
            name[a] = name[b] = min(name[a], name[b])
    got = {r.cluster: r for r in spheres.merged_spheres(df, threshold).collect()}
    assert set(got) == set(name.values())
    for c, r in got.items():
        part = [m for m in made if name[m[0]] == c]
        w = sum(m[3] for m in part)
        middle = [sum(m[1][i] * m[3] for m in part) / w for i in range(3)]
        assert r.members == len(part) and r.weight == w and r.centre == pytest.approx(middle)
        assert r.radius == pytest.approx(max(math.dist(m[1], middle) + m[2] for m in part))
    assert spheres.merged_spheres(df.where("false"), threshold).collect() == []


def test_long_chains_settle(spark):
    n = 300
    nodes = spark.range(n).selectExpr("id as node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 150], "a long, b long")
    got = {r.node: r.component for r in spheres.joined(nodes, edges).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(n)}
