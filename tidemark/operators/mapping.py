"""The cluster mapping measure with its analysis of the ground truth, at every sample of a sliding horizon.

All of it follows from the distances of each point to its nearest few in each class.  These are kept for every pair of panes
(`horizons`), and merged for a sample from the pairs its horizon holds; the nearest in a union of classes are the nearest of
theirs, so classes can be joined without another look at points.  What is left of a sample, a few numbers a point and class
of its horizon, is one task's work, and samples are worked on side by side.

Analysis: a point is tied to a class fully where its mean distance to its `k` nearest there is below the class's usual (mean plus
deviation over its own points), and by usual / distance beyond.  A class is tied to another by the mean of the `k` largest
ties of its points.  As long as two classes are tied both ways beyond `tau`, the best tied (of equals the first) are joined, and
the ties of the union are found anew.  Separability is the share of classes left; noise separability one less the mean of the
largest tie of noise; model quality the share of points in no sphere of another class.

Mapping: a found cluster stands for the class that alone has points in it, or whose profile of points fits the cluster's: a class
whose own spheres hold as many points of each class as the cluster does (of several the one with most points in it), or else the
one that lacks fewest.  Points outside all clusters, in clusters of other classes, and noise in clusters cost by their ties.

Defined results: noise has label -1; classes are those with points in the horizon, in the order of their labels; a class of one
point has ties of 0 to it; null labels are noise; points that cannot be mapped cost 1; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import kept

from .clustering import INSIDE, inclusion, literal, squared
from .horizons import over_samples, pair_statistics, paned, to_samples

OUTPUTS = ["cmm", "cmm_basic", "cmm_missed", "cmm_misplaced", "cmm_noise", "ca_separability", "ca_noise", "ca_model"]
#: What an error costs that the model of the truth makes as well.
LEAST = 1e-5


class Truth:
    """Classes of a horizon, joined as far as they cannot be told apart; `near` holds distances (points x classes x k, infinite where there are fewer)."""

    def __init__(self, near: np.ndarray, label: np.ndarray, tau: float):
        self.near, self.k = np.sort(near, axis=2), near.shape[2]
        self.members = [np.flatnonzero(label == c) for c in range(near.shape[1])]
        self.parts = [[c] for c in range(near.shape[1])]
        self.usual = [self._usual(c) for c in range(len(self.parts))]
        ties = np.array([[self._tied(a, b) for b in range(len(self.parts))] for a in range(len(self.parts))]).reshape(len(self.parts), len(self.parts))
        while len(self.parts) > 1:
            both = np.where(np.triu(np.ones_like(ties), 1) > 0, np.minimum(ties, ties.T), -1.0)
            a, b = np.unravel_index(int(both.argmax()), both.shape)
            if not both[a, b] > tau:
                break
            self.near[:, a] = np.sort(np.concatenate([self.near[:, a], self.near[:, b]], axis=1), axis=1)[:, : self.k]
            self.near = np.delete(self.near, b, axis=1)
            ties = np.delete(np.delete(ties, b, 0), b, 1)
            self.members[a] = np.concatenate([self.members[a], self.members[b]])
            self.parts[a] += self.parts[b]
            for held in (self.members, self.parts, self.usual):
                del held[b]
            self.usual[a] = self._usual(a)
            for c in range(len(self.parts)):
                ties[a, c], ties[c, a] = self._tied(a, c), self._tied(c, a)
        self.work = np.full(len(label), -1)
        for c, at in enumerate(self.members):
            self.work[at] = c
        self.ties = np.stack([self._ties(np.arange(len(label)), c) for c in range(len(self.parts))], 1) if self.parts else np.zeros((len(label), 0))

    def _mean(self, at: np.ndarray, c: int) -> np.ndarray:
        """Mean distances to the nearest in a class; NaN where it has no other point."""
        d = self.near[at, c]
        n = np.isfinite(d).sum(1)
        return np.where(n > 0, np.where(np.isfinite(d), d, 0.0).sum(1) / np.maximum(n, 1), np.nan)

    def _usual(self, c: int) -> float:
        own = np.nan_to_num(self._mean(self.members[c], c))
        variance = (own**2).mean() - own.mean() ** 2
        return float(own.mean() + math.sqrt(variance if variance > 0 else 1e-50))

    def _ties(self, at: np.ndarray, c: int) -> np.ndarray:
        d = self._mean(at, c)
        return np.where(np.isnan(d), 0.0, np.where(d < self.usual[c], 1.0, self.usual[c] / np.where(d > 0, d, 1.0)))

    def _tied(self, a: int, b: int) -> float:
        if a == b:
            return 1.0
        return float(np.sort(self._ties(self.members[a], b))[-self.k :].mean())


def matched(inside: np.ndarray, model: np.ndarray, work: np.ndarray) -> list[int]:
    """The class that each found cluster stands for, -1 for none; `inside` is points x clusters, `model` points x classes."""
    classes, real = model.shape[1], work >= 0
    one = np.eye(classes, dtype=int)[work[real]]
    found = inside[real].T.astype(int) @ one
    # a class's profile: its own points, and those of others that its spheres hold
    held = (model[real] & ~(one > 0)).T.astype(int) @ one + np.diag(one.sum(0))
    out = []
    for counts in found:
        there = np.flatnonzero(counts)
        if len(there) < 2:
            out.append(int(there[0]) if len(there) else -1)
            continue
        lacking = np.maximum(counts[None, :] - held, 0).sum(1)
        fits = np.flatnonzero(lacking == 0)
        out.append(int(fits[counts[fits].argmax()]) if len(fits) else int(lacking.argmin()))
    return out


def mapped(near: np.ndarray, label: np.ndarray, inside: np.ndarray, hull: np.ndarray, spheres: np.ndarray, tau: float = 0.5, missed_rate: float = 1.0) -> dict[str, float]:
    """The outputs for one horizon.

    label: the number of a point's class, -1 for noise; inside, hull: points x found clusters, the latter how far outside
    ((d - r) / (d + r)); spheres: points x classes, whether a sphere of the class holds the point.
    """
    truth = Truth(near, label, tau)
    work, n = truth.work, len(label)
    model = np.stack([spheres[:, p].any(1) for p in truth.parts], 1) if truth.parts else np.zeros((n, 0), bool)
    match = matched(inside, model, work)
    noise, covered = work < 0, inside.any(1)
    tied = np.ones(n)
    tied[~noise] = truth.ties[np.flatnonzero(~noise), work[~noise]]
    error = np.zeros(n)
    for f, c in enumerate(match):
        at = np.flatnonzero(inside[:, f] & ((work != c) | noise))
        if c < 0:
            cost = np.ones(len(at))
        else:
            away = 1 - truth.ties[at, c]
            cost = np.where(noise[at], away, np.where(away == 0, LEAST, away * tied[at]))
            cost = np.where(model[at, c], LEAST, cost)
        error[at] = np.maximum(error[at], cost)
    missed = np.flatnonzero(~noise & ~covered)
    out_of = np.ones(len(missed))
    for f, c in enumerate(match):
        out_of = np.where((work[missed] == c) & (hull[missed, f] < out_of), hull[missed, f], out_of)
    error[missed] = (1 - np.exp(-missed_rate * np.minimum(out_of, 1))) * tied[missed]
    left = lambda part, whole: float(1 - error[part].sum() / tied[whole].sum()) if tied[whole].sum() else 1.0
    other = spheres.copy()
    other[~noise, label[~noise]] = False
    return {
        "cmm": left(np.ones(n, bool), np.ones(n, bool)), "cmm_basic": float(1 - (error != 0).mean()), "cmm_missed": left(missed, ~noise), "cmm_misplaced": left(~noise & covered, ~noise), "cmm_noise": left(noise & covered, noise),
        "ca_separability": len(truth.parts) / near.shape[1] if near.shape[1] else 1.0, "ca_noise": float(1 - truth.ties[noise].max(1, initial=0.0).mean()) if noise.any() else 1.0, "ca_model": float(1 - other.any(1).mean()),
    }


def cluster_mapping(points: DataFrame, order: str, clusters: list, truth: list, every: int, panes: int, k: int = 2, tau: float = 0.5) -> DataFrame:
    """sample, and the outputs: found `clusters` against `truth`, spheres whose cluster is a label, over the last `panes` * `every` points."""
    reach = F.transform(literal(clusters), lambda c: F.struct(F.sqrt(squared(F.col("x"), c["centre"])).alias("d"), c["radius"].alias("r")))
    hull = F.transform(reach, lambda s: F.when(s["d"] + s["r"] > 0, (s["d"] - s["r"]) / (s["d"] + s["r"])).otherwise(0.0))
    held = F.filter(literal(truth), lambda c: inclusion(F.sqrt(squared(F.col("x"), c["centre"])), c["radius"], c["weight"]) > INSIDE)
    noted = points.withColumn("label", F.coalesce(F.col("label").cast("int"), F.lit(-1)))
    rows = paned(noted, order, every, clusters, hull=hull, model=F.array_distinct(F.transform(held, lambda c: c["cluster"])))
    end = rows.agg(F.max("pane")).first()[0]
    outputs = ", ".join(f"{o} double" for o in OUTPUTS)
    if end is None:
        return rows.sparkSession.createDataFrame([], f"sample int, {outputs}")
    classes = sorted(r.label for r in rows.where("label != -1").select("label").distinct().collect())  # a row a class
    names = [r["cluster"] for r in clusters]
    paired = kept(pair_statistics(rows, panes, names, classes, k, parts=()), "near")
    near = over_samples(paired, panes, end).groupBy("sample", "rn", "cluster").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ds"))), 1, k).alias("ds"))
    near = near.groupBy("sample", "rn").agg(F.collect_list(F.struct("cluster", "ds")).alias("near"))
    each = to_samples(rows.select("pane", "rn", "label", "own", "hull", "model"), F.col("pane"), F.col("pane") + panes - 1, end).drop("pane")

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("rn")
        label = group["label"].to_numpy()
        here = sorted(set(label.tolist()) - {-1})
        at = {c: j for j, c in enumerate(here)}
        n = len(label)
        found = np.full((n, len(here), k), np.inf)
        for i, told in enumerate(group["near"].to_pylist()):
            for pair in told or []:
                if pair["cluster"] in at:
                    found[i, at[pair["cluster"]], : len(pair["ds"])] = pair["ds"]
        inside = np.array([[c in own for c in names] for own in group["own"].to_pylist()], bool).reshape(n, len(names))
        spheres = np.array([[c in held for c in here] for held in group["model"].to_pylist()], bool).reshape(n, len(here))
        hull = np.array(group["hull"].to_pylist(), float).reshape(n, len(names))
        out = mapped(found, np.array([at.get(v, -1) for v in label.tolist()]), inside, hull, spheres, tau)
        return pa.table({"sample": pa.array([group["sample"][0].as_py()], pa.int32()), **{o: [out[o]] for o in OUTPUTS}})

    return each.join(near, ["sample", "rn"], "left").groupBy("sample").applyInArrow(one, f"sample int, {outputs}")
