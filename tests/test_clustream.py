"""Macro clusters: what they read, and how often."""

import numpy as np
import pytest

from tidemark.operators import micro as M


@pytest.mark.parametrize("parts", [1, 2])
def test_points_are_folded_once(spark, parts):
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).standard_normal((300, 2)))]

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    points = spark.createDataFrame(rows, "id long, x array<double>").mapInPandas(counted, "id long, x array<double>")
    out = (M.macro(points, "id", 10, 50, 3) if parts == 1 else M.distributed(points, "id", parts, 10, 50, 3)).collect()
    assert sum(r.kernels for r in out) == 10 * parts
    assert seen.value == 300
