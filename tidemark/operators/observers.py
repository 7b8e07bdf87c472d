"""Order-dependent observers of a numeric attribute: small summaries, folded per key.

They have bounded size, so rows stream through a fold per (attribute, key); the exact, order-free
alternative is `statistics.numeric_cuts`.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bins:
    """At most `limit` bins: the first distinct values open them, later ones fall in the bin below or at them.

    A bin keeps class weights, and apart from them the weights of the very value that opened it, so that
    a cut at that value parts its rows exactly.
    """

    def __init__(self, classes: int, limit: int = 10):
        self.classes, self.limit = classes, limit
        self.low: list[float] = []
        self.weights: list[np.ndarray] = []
        self.edge: list[np.ndarray] = []
        self.least, self.most = np.inf, -np.inf

    def add(self, x: float, y: int, w: float = 1.0) -> None:
        if x is None or x != x or w <= 0:
            return
        self.least, self.most = min(self.least, x), max(self.most, x)
        k = bisect.bisect_right(self.low, x) - 1
        if (k < 0 or self.low[k] != x) and len(self.low) < self.limit:
            k += 1
            self.low.insert(k, x)
            self.weights.insert(k, np.zeros(self.classes))
            self.edge.insert(k, np.zeros(self.classes))
        k = max(k, 0)
        (self.edge if self.low[k] == x else self.weights)[k][y] += w

    def cuts(self) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(cut, weights at or below, weights above) at each bin's first value, but for the last row's."""
        if not self.low:
            return []
        total = sum(self.weights) + sum(self.edge)
        out, below = [], np.zeros(self.classes)
        for k, v in enumerate(self.low):
            at = below + self.edge[k]
            if v < self.most:
                out.append((v, at, total - at))
            below = at + self.weights[k]
        return out


class Quantiles:
    """Greenwald and Khanna's summary with at most `limit` tuples (value, rows since the one before, slack)."""

    def __init__(self, limit: int = 10):
        self.limit, self.n = limit, 0
        self.tuples: list[list[float]] = []

    def add(self, x: float) -> None:
        if x is None or x != x:
            return
        self.n += 1
        k = bisect.bisect_right([t[0] for t in self.tuples], x)
        slack = 0 if k == len(self.tuples) else self.tuples[k][1] + self.tuples[k][2] - 1
        self.tuples.insert(k, [x, 1, slack])
        if len(self.tuples) >= self.limit:
            # a tuple may go into the next one only if it is no surer than that, on which the error bound rests;
            # of those the pair that is least full is joined, and the first and the last value stay
            inner = range(1, len(self.tuples) - 1)
            sure = [i for i in inner if self.tuples[i][2] >= self.tuples[i + 1][2]]
            if sure or len(self.tuples) > self.limit:
                k = min(sure or inner, key=lambda i: self.tuples[i][1] + self.tuples[i + 1][1] + self.tuples[i + 1][2])
                self.tuples[k + 1][1] += self.tuples[k][1]
                del self.tuples[k]

    def below(self, x: float) -> float:
        """About how many rows are below x."""
        rank = 0.0
        for k, (v, g, d) in enumerate(self.tuples):
            if v >= x:
                return rank if not k else rank + max(g - 1, 0) * (x - self.tuples[k - 1][0]) / ((v - self.tuples[k - 1][0]) or 1.0)
            rank += g
        return float(self.n)

    def quantile(self, q: float) -> float | None:
        target, rank = math.ceil(q * self.n), 0
        for (v, g, _), (_, after, _) in zip(self.tuples, self.tuples[1:]):
            rank += g
            if rank + after > target:
                return v
        return self.tuples[-1][0] if self.tuples else None

    def error(self) -> int:
        """The most rows by which a rank can be wrong."""
        return max((int(g + d) for _, g, d in self.tuples[1:-1]), default=0)


class Nothing:
    """Observes nothing and suggests no cut: for attributes that a learner is to leave alone."""

    def add(self, x: float, y=None, w: float = 1.0) -> None:
        pass

    def cuts(self) -> list:
        return []


class LimitedMoments:
    """Target moments at or below at most `limit` values: the first distinct ones are the cut points."""

    def __init__(self, limit: int = 50):
        self.limit, self.points, self.sums = limit, [], []
        self.total = [0.0, 0.0, 0.0]

    def add(self, x: float, y: float) -> None:
        if x is None or x != x:
            return
        k = bisect.bisect_left(self.points, x)
        if (k == len(self.points) or self.points[k] != x) and len(self.points) < self.limit:
            self.points.insert(k, x)
            self.sums.insert(k, [0.0, 0.0, 0.0])
        for s in (self.total, self.sums[k]) if k < len(self.points) else (self.total,):
            s[0] += 1.0
            s[1] += y
            s[2] += y * y

    def cuts(self) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out, below, total = [], np.zeros(3), np.array(self.total)
        for x, s in zip(self.points, self.sums):
            below = below + s
            out.append((x, below, total - below))
        return out


def summarised(df: DataFrame, key: str, order: str, x: str, limit: int = 10) -> DataFrame:
    """Quantile summaries per key: key, n, lower quartile, median, upper quartile; rows stream through the fold."""
    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, order, F.col(x).cast("double").alias("x")).repartition(key).sortWithinPartitions(key, order)

    def run(batches):
        last, held, started = None, None, False

        def told(rows):
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (None, pa.int64(), *(pa.float64(),) * 3)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t or schema_key) for c, t in zip(columns, kinds)], [key, "n", "lower", "median", "upper"])

        for batch in batches:
            schema_key = batch.schema.field(0).type
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not started or k != last:
                    if started:
                        out.append((last, held.n, *(held.quantile(q) for q in (0.25, 0.5, 0.75))))
                    last, held, started = k, Quantiles(limit), True
                held.add(v)
            yield told(out)
        if started:
            yield told([(last, held.n, *(held.quantile(q) for q in (0.25, 0.5, 0.75)))])

    return dealt.mapInArrow(run, f"{key} {kind}, n long, lower double, median double, upper double")


def observed_cuts(df: DataFrame, key: str, order: str, x: str, y: str, make) -> DataFrame:
    """The cuts of one observer per key: key, cut, below, above (weights or sums of the rows on either side).

    Rows are folded in order; rows without a value or target are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, order, F.col(x).cast("double").alias("x"), F.col(y).alias("y")).where("x is not null and y is not null").repartition(key).sortWithinPartitions(key, order)

    def run(batches):
        last, held, schema_key = None, None, None

        def told():
            rows = [(last, float(cut), below.tolist(), above.tolist()) for cut, below, above in held.cuts()]
            kinds = (schema_key, pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [key, "cut", "below", "above"])

        for batch in batches:
            schema_key = batch.schema.field(0).type
            for k, v, target in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if held is None or k != last:
                    if held is not None:
                        yield told()
                    last, held = k, make()
                held.add(v, target)
        if held is not None:
            yield told()

    return dealt.mapInArrow(run, f"{key} {kind}, cut double, below array<double>, above array<double>")


def perturbed(clusters: list[dict], seed: int = 227, remove: float = 0.0, shift: float = 0.0, shrink: float = 0.0, join: float = 0.0, extra: int = 0) -> list[dict]:
    """A clustering (dicts of centre, radius, weight) with errors put in; the input stays as it is.

    Clusters go with probability `remove`; centres move by up to 2 * radius * `shift` in a random
    direction, reflected at the walls of the unit cube; radii shrink by the share `shrink`; neighbours
    whose hulls are nearer than `join` times the smaller radius become one; `extra` random copies of half
    the weight are added.
    """
    rng = np.random.default_rng(seed)
    out = [{**c, "centre": np.array(c["centre"], float)} for c in clusters if rng.random() >= remove]
    for c in out:
        way = rng.standard_normal(len(c["centre"]))
        way /= np.sqrt((way * way).sum()) or 1.0
        moved = c["centre"] + way * 2 * c["radius"] * shift * rng.random()
        c["centre"] = 1 - np.abs(1 - np.abs(moved))
        c["radius"] *= 1 - shrink
    joined: list[dict] = []
    for c in out:
        near = next((j for j in joined if join > 0 and np.sqrt(((j["centre"] - c["centre"]) ** 2).sum()) - j["radius"] - c["radius"] < join * min(j["radius"], c["radius"])), None)
        if near is None:
            joined.append(c)
            continue
        w = near["weight"] + c["weight"]
        gap = float(np.sqrt(((near["centre"] - c["centre"]) ** 2).sum()))
        near["centre"] = (near["weight"] * near["centre"] + c["weight"] * c["centre"]) / w
        near["radius"], near["weight"] = max(near["radius"], c["radius"], (near["radius"] + c["radius"] + gap) / 2), w
    for _ in range(extra if joined else 0):
        c = joined[int(rng.integers(len(joined)))]
        joined.append({**c, "centre": rng.random(len(c["centre"])), "weight": c["weight"] / 2})
    return joined


def class_indexes(labels: list, noise=-1) -> dict:
    """Dense numbers for labels in the order of their first appearance; noise, if there, comes last."""
    seen = [v for v in dict.fromkeys(labels) if v != noise]
    return {v: k for k, v in enumerate([*seen, *([noise] if noise in labels else [])])}
