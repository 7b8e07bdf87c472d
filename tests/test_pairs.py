"""The step that pairs blocks of points: copies of a point, and distances of points that are the same."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clustering as C
from tidemark.operators import micro as M


def test_copies_of_a_point_do_not_grow_with_the_points(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    copies = {}
    for n in (100, 400):
        held = spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("x"))
        copies[n] = C._block_pairs(held).count() / n
    assert copies[100] == copies[400] == C.BLOCKS


@pytest.mark.parametrize("most", [65_536, 5])
def test_exact_copies_are_at_distance_zero(spark, monkeypatch, most):
    monkeypatch.setattr(C, "BLOCK", 7)
    monkeypatch.setattr(C, "MOST", most)
    monkeypatch.setattr(C, "PIECE", 4)
    x = np.random.default_rng(3).standard_normal((12, 8)) * 10 + 100
    points = spark.createDataFrame([(12 * copy + i, v.tolist(), i % 2) for copy in range(4) for i, v in enumerate(x)], "id long, x array<double>, label int")
    con = M.connectivity(points).toPandas()
    assert len(con) == 96
    assert set(con[con["label"] == con["class"]]["con"]) == {1.0}  # every point has its copies
    assert set(con[con["label"] != con["class"]]["con"]) == {0.0}


def test_pairs_within_clusters_and_silhouette_over_small_pieces(spark, monkeypatch):
    for name, v in (("BLOCK", 6), ("MOST", 9), ("PIECE", 2)):
        monkeypatch.setattr(C, name, v)
    x = np.random.default_rng(4).standard_normal((50, 3))
    points = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, x array<double>, label int")
    clusters = [{"cluster": k, "centre": c, "radius": 9.0, "weight": 9.0} for k, c in ((1, [0.0] * 3), (2, [0.5] * 3))]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(50, 1)]
    assert C.c_index(points, clusters).first()[0] == pytest.approx((d.mean() - d.min()) / (d.max() - d.min()))
    assert math.isclose(C.silhouette(points, clusters).first()[0], 0.5)  # both hold all points
