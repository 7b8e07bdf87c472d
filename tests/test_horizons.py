"""Measures over sliding horizons: at each sample those of the whole-table functions on the horizon's points."""

import random

import pytest

from tidemark.operators import clustering as C
from tidemark.operators import horizons as H

CLUSTERS = [{"cluster": 3, "centre": [0.0, 0.0], "radius": 1.2, "weight": 9.0}, {"cluster": 7, "centre": [1.0, 1.0], "radius": 1.0, "weight": 9.0}, {"cluster": 8, "centre": [5.0, 5.0], "radius": 0.4, "weight": 3.0}]


def points(spark, n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        k = rng.randrange(4)
        centre = [(0, 0), (1, 1), (5, 5), (2, 3)][k]
        label = -1 if k == 3 and rng.random() < 0.7 else k
        rows.append((10 * i - 50, [rng.gauss(c, 0.5) for c in centre], label))
    return rows, spark.createDataFrame(rows, "t long, x array<double>, label int").selectExpr("*", "'a' as own", "1 as pane", "2 as sample")


def whole(spark, rows):
    df = spark.createDataFrame([(t, x, label) for t, x, label in rows], "id long, x array<double>, label int")
    cells = C.membership(df, CLUSTERS)
    out = {"ssq": C.ssq(df, CLUSTERS).first().ssq, "silhouette": C.silhouette(df, CLUSTERS).first().silhouette, "c_index": C.c_index(df, CLUSTERS).first().c_index}
    for frame in (C.pair_measures(cells), C.entropies(cells, len(CLUSTERS) + 1), C.f1_purity(cells), C.general(df, CLUSTERS).drop("clusters", "classes")):
        out |= frame.first().asDict()
    return out


def test_each_sample_is_its_horizon(spark):
    rows, df = points(spark, 110)
    got = {}
    for r in H.evaluated(df.repartition(6), "t", CLUSTERS, 25, 3, H.MEASURES).collect():
        got.setdefault(r.sample, {})[r.measure] = r.value
    assert sorted(got) == [0, 1, 2, 3, 4]
    for s in (0, 2, 4):
        want = whole(spark, rows[max(0, (s - 2) * 25) : (s + 1) * 25])
        assert set(got[s]) == set(want) == set(H.MEASURES)
        for m in want:
            assert got[s][m] == pytest.approx(want[m], abs=1e-9), (s, m)


def test_only_panes_that_share_a_horizon_are_compared(spark):
    _, df = points(spark, 200)
    rows = H.paned(df, "t", 20, CLUSTERS)
    found = H.pair_statistics(rows, 3, [3, 7, 8]).select("low", "high").distinct().collect()
    assert {(r.low, r.high) for r in found} <= {(a, b) for a in range(10) for b in range(a, min(a + 3, 10))}
    assert len(found) > 20


def test_chosen_measures_and_odd_tables(spark):
    _, df = points(spark, 40)
    got = H.evaluated(df, "t", CLUSTERS, 30, 1, ["purity", "ssq"]).collect()
    assert sorted((r.sample, r.measure) for r in got) == [(0, "purity"), (0, "ssq"), (1, "purity"), (1, "ssq")]
    with pytest.raises(ValueError, match="no measures"):
        H.evaluated(df, "t", CLUSTERS, 30, 1, ["purity", "beauty"])
    assert H.evaluated(df.where("false"), "t", CLUSTERS, 30, 1, H.MEASURES).collect() == []
    # nothing is covered: measures of clusters are null, the others are there
    far = [{"cluster": 1, "centre": [99.0, 99.0], "radius": 0.1, "weight": 2.0}]
    got = {r.measure: r.value for r in H.evaluated(df, "t", far, 100, 1, H.MEASURES).collect()}
    assert got["silhouette"] is None and got["c_index"] is None and got["purity"] is None and got["recall"] == 0.0 and got["f1_r"] == 0.0
