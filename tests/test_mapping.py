"""The cluster mapping measure against a specification that goes point by point and measures every distance where it needs it."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import mapping


class Spec:
    """As defined: lists of points, classes that are joined, all distances taken anew."""

    def __init__(self, points, clusters, truth, tau=0.5, k=2):
        self.points, self.k = points, k
        self.labels = sorted({label for _, label in points if label != -1})
        self.of = {c: c for c in self.labels}
        while True:
            now = sorted(set(self.of.values()), key=self.labels.index)
            best, pair = tau, None
            for i, a in enumerate(now):
                for b in now[i + 1 :]:
                    v = min(self.class_tie(a, b), self.class_tie(b, a))
                    if v > best:
                        best, pair = v, (a, b)
            if pair is None:
                break
            self.of = {c: pair[0] if v == pair[1] else v for c, v in self.of.items()}
        self.now = now
        self.clusters, self.truth = clusters, truth

    def members(self, c):
        return [i for i, (_, label) in enumerate(self.points) if label != -1 and self.of[label] == c]

    def far(self, i, c):
        d = sorted(math.dist(self.points[i][0], self.points[j][0]) for j in self.members(c) if j != i)[: self.k]
        return sum(d) / len(d) if d else None

    def usual(self, c):
        own = [self.far(i, c) or 0.0 for i in self.members(c)]
        mean = sum(own) / len(own)
        variance = sum(v * v for v in own) / len(own) - mean * mean
        return mean + math.sqrt(variance if variance > 0 else 1e-50)

    def tie(self, i, c):
        d = self.far(i, c)
        u = self.usual(c)
        return 0.0 if d is None else 1.0 if d < u else u / d

    def class_tie(self, a, b):
        top = sorted((self.tie(i, b) for i in self.members(a)), reverse=True)[: self.k]
        return sum(top) / len(top)

    def within(self, i, sphere):
        return math.dist(self.points[i][0], sphere["centre"]) <= sphere["radius"]

    def model(self, i, c):
        return any(self.of.get(s["cluster"]) == c and self.within(i, s) for s in self.truth)

    def work(self, i):
        label = self.points[i][1]
        return None if label == -1 else self.of[label]

    def match(self, f):
        counts = {c: sum(self.within(i, f) for i in self.members(c)) for c in self.now}
        there = [c for c in self.now if counts[c]]
        if len(there) < 2:
            return there[0] if there else None
        best = None
        fits = []
        for c in self.now:
            lack = 0
            for o in self.now:
                held = len(self.members(o)) if o == c else sum(self.model(i, c) for i in self.members(o))
                lack += max(counts[o] - held, 0)
            if lack == 0:
                fits.append(c)
            if best is None or lack < best[0]:
                best = (lack, c)
        return max(fits, key=lambda c: counts[c]) if fits else best[1]

    def outputs(self):
        n = len(self.points)
        stands = [self.match(f) for f in self.clusters]
        sums = dict.fromkeys(["all", "missed", "misplaced", "noise", "top", "top_noise", "errors"], 0.0)
        for i in range(n):
            w = self.work(i)
            tied = 1.0 if w is None else self.tie(i, w)
            hit = [k for k, f in enumerate(self.clusters) if self.within(i, f)]
            err = 0.0
            for k in hit:
                c = stands[k]
                if w is not None and c == w:
                    continue
                if c is None:
                    err = max(err, 1.0)
                elif self.model(i, c):
                    err = max(err, 1e-5)
                elif w is None:
                    err = max(err, 1 - self.tie(i, c))
                else:
                    away = 1 - self.tie(i, c)
                    err = max(err, away * tied if away else 1e-5)
            if not hit and w is not None:
                least = 1.0
                for f, c in zip(self.clusters, stands):
                    if c == w:
                        d = math.dist(self.points[i][0], f["centre"])
                        least = min(least, (d - f["radius"]) / (d + f["radius"]))
                err = (1 - math.exp(-least)) * tied
            sums["all"] += err
            sums["top"] += tied
            sums["top_noise"] += tied if w is None else 0
            sums["errors"] += err != 0
            sums["noise" if w is None else "misplaced" if hit else "missed"] += err
        share = lambda e, t: 1 - e / t if t else 1.0
        real = sums["top"] - sums["top_noise"]
        noise = [i for i in range(n) if self.work(i) is None]
        strange = sum(any(s["cluster"] != self.points[i][1] and self.within(i, s) for s in self.truth if s["cluster"] in self.labels) for i in range(n))
        return {
            "cmm": share(sums["all"], sums["top"]), "cmm_basic": 1 - sums["errors"] / n, "cmm_missed": share(sums["missed"], real), "cmm_misplaced": share(sums["misplaced"], real), "cmm_noise": share(sums["noise"], sums["top_noise"]),
            "ca_separability": len(self.now) / len(self.labels), "ca_noise": 1 - sum(max(self.tie(i, c) for c in self.now) for i in noise) / len(noise) if noise else 1.0, "ca_model": 1 - strange / n,
        }


CLUSTERS = [{"cluster": 0, "centre": [0.2, 0.1], "radius": 1.1, "weight": 9.0}, {"cluster": 4, "centre": [2.0, 1.0], "radius": 1.3, "weight": 9.0}, {"cluster": 5, "centre": [6.0, 6.0], "radius": 0.8, "weight": 9.0}, {"cluster": 6, "centre": [-9.0, 0.0], "radius": 1.0, "weight": 9.0}]
TRUTH = [{"cluster": 1, "centre": [0.0, 0.0], "radius": 1.2, "weight": 9.0}, {"cluster": 2, "centre": [2.2, 1.0], "radius": 1.2, "weight": 9.0}, {"cluster": 3, "centre": [6.0, 6.0], "radius": 1.0, "weight": 9.0}, {"cluster": 1, "centre": [0.0, 3.0], "radius": 0.7, "weight": 9.0}, {"cluster": 7, "centre": [6.5, 6.2], "radius": 0.9, "weight": 9.0}]


def rows(n, seed, spread=0.5):
    rng, out = random.Random(seed), []
    centres = {1: (0, 0), 2: (2.2, 1), 3: (6, 6), 7: (6.5, 6.2), -1: (3, 3)}
    for i in range(n):
        label = rng.choice([1, 1, 2, 2, 3, 7, -1])
        out.append((7 * i, [rng.gauss(c, spread if label != -1 else 3.0) for c in centres[label]], label))
    return out


def test_each_horizon_as_specified(spark):
    data = rows(130, 3)
    df = spark.createDataFrame(data, "t long, x array<double>, label int").selectExpr("*", "'a' as near", "1 as hull", "'m' as model")
    got = {r.sample: r for r in mapping.cluster_mapping(df.repartition(5), "t", CLUSTERS, TRUTH, 30, 2).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    joined = 0
    for s, r in got.items():
        part = [(x, label) for _, x, label in data[max(0, (s - 1) * 30) : (s + 1) * 30]]
        want = Spec(part, CLUSTERS, TRUTH).outputs()
        for o in mapping.OUTPUTS:
            assert r[o] == pytest.approx(want[o], abs=1e-9), (s, o)
        joined += want["ca_separability"] < 1
    assert joined and len({round(r.cmm, 6) for r in got.values()}) == 5


@pytest.mark.parametrize("seed, spread", [(1, 0.3), (2, 1.5), (5, 0.8), (8, 2.5)])
def test_joining_classes_as_specified(seed, spread):
    data = [(x, label) for _, x, label in rows(60, seed, spread)]
    labels = sorted({label for _, label in data} - {-1})
    label = np.array([labels.index(v) if v != -1 else -1 for _, v in data])
    near = np.full((len(data), len(labels), 2), np.inf)
    for i, (x, _) in enumerate(data):
        for c, v in enumerate(labels):
            d = sorted(math.dist(x, y) for j, (y, w) in enumerate(data) if w == v and j != i)[:2]
            near[i, c, : len(d)] = d
    truth, spec = mapping.Truth(near, label, 0.5), Spec(data, CLUSTERS, TRUTH)
    assert [sorted(labels[c] for c in p) for p in truth.parts] == [[c for c in labels if spec.of[c] == name] for name in spec.now]
    assert np.allclose(truth.ties, [[spec.tie(i, c) for c in spec.now] for i in range(len(data))])


def test_odd_horizons(spark):
    schema = "t long, x array<double>, label int"
    lone = spark.createDataFrame([(1, [0.0, 0.0], 1)], schema)
    r = mapping.cluster_mapping(lone, "t", CLUSTERS, TRUTH, 10, 3).first()
    assert (r.ca_separability, r.ca_noise, r.ca_model, r.cmm) == (1.0, 1.0, 1.0, 1.0)
    noise = spark.createDataFrame([(i, [0.1 * i, 0.0], None if i % 2 else -1) for i in range(6)], schema)
    r = mapping.cluster_mapping(noise, "t", CLUSTERS, TRUTH, 10, 3).first()
    assert r.cmm == 0.0 and r.cmm_noise == 0.0 and r.ca_separability == 1.0 and r.cmm_missed == 1.0
    assert mapping.cluster_mapping(lone.where("false"), "t", CLUSTERS, TRUTH, 10, 3).collect() == []
    # nothing found: all real points are missed
    r = mapping.cluster_mapping(spark.createDataFrame(rows(40, 6), schema), "t", [], TRUTH, 50, 1).first()
    assert r.cmm_missed == pytest.approx(math.exp(-1)) and r.cmm_misplaced == 1.0 and r.cmm_noise == 1.0
