"""Order-dependent clustering: CluStream kernels, macro clusters, enclosing balls and CMM.

CluStream keeps at most `kernels` features, so its state is bounded; rows stream through the fold in
order.  Distributed runs fold each part on its own and merge the kernels, keeping their weights.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import checkpointed

from .clustering import RADIUS_FACTOR, TINY, _block_pairs, _matrix, _pieces, _same, _sides, inside, lloyd, nearest

NORMAL = NormalDist()
KERNEL = "part int, kernel int, n double, ls array<double>, ss array<double>, lst double, sst double"


class CluStream:
    """At most `kernels` cluster features; a point joins the nearest one or starts a new one in the place
    of one that is out of date, or of the closest pair, which merge."""

    def __init__(self, kernels: int = 100, horizon: int = 1000, recent: int = 100):
        self.kernels, self.horizon, self.recent = kernels, horizon, recent
        self.n = self.ls = self.ss = self.lst = self.sst = None
        self.buffer: list[tuple[int, np.ndarray]] = []

    def _start(self):
        x = np.array([p for _, p in self.buffer])
        t = np.array([float(s) for s, _ in self.buffer])
        self.n, self.ls, self.ss, self.lst, self.sst = np.ones(len(x)), x.copy(), x * x, t, t * t
        self.buffer = []
        self.centres = self.ls / self.n[:, None]
        # squared gaps between centres (infinite to itself), the time that `_stamps` gives, and the radius where it is known
        self.gaps = ((self.centres[:, None] - self.centres[None]) ** 2).sum(2)
        np.fill_diagonal(self.gaps, np.inf)
        self.stamps = self._stamps()
        self.radii: list[float | None] = [None] * len(x)

    def add(self, t: int, x: np.ndarray) -> None:
        if self.n is None:
            self.buffer.append((t, x))
            if len(self.buffer) == self.kernels:
                self._start()
            return
        d = ((self.centres - x) ** 2).sum(1)
        k = int(d.argmin())
        if self.n[k] > 1:
            radius = self.radii[k] = self._radius(k) if self.radii[k] is None else self.radii[k]
        else:
            radius = math.sqrt(self.gaps[k].min())
        if math.sqrt(d[k]) <= radius:
            self._insert(k, t, x)
            return
        old = int((self.stamps < t - self.horizon).argmax())
        if self.stamps[old] < t - self.horizon:
            self._replace(old, t, x)
            return
        # the first of the closest pairs: gaps are the same both ways, so its first row is the lower place
        a, b = divmod(int(self.gaps.argmin()), len(self.gaps))
        for s in (self.n, self.ls, self.ss, self.lst, self.sst):
            s[a] += s[b]
        self._changed(a)
        self._replace(b, t, x)

    def _changed(self, k: int) -> None:
        """What follows from the features of one kernel."""
        self.centres[k] = self.ls[k] / self.n[k]
        gaps = ((self.centres - self.centres[k]) ** 2).sum(1)
        gaps[k] = np.inf
        self.gaps[k] = self.gaps[:, k] = gaps
        self.stamps[k] = self._stamp(k)
        self.radii[k] = None

    def _radius(self, k: int) -> float:
        v = self.ss[k] / self.n[k] - (self.ls[k] / self.n[k]) ** 2
        return float(np.sqrt(np.maximum(np.where((v <= 0) & (v > -5e-5), TINY, v), 0)).mean() * RADIUS_FACTOR)

    def _stamp(self, k: int) -> float:
        """The mean time of a kernel, or about its `recent`-th youngest point's."""
        n = float(self.n[k])
        mean = float(self.lst[k]) / n
        if n < 2 * self.recent:
            return mean
        sd = math.sqrt(max(float(self.sst[k]) / n - mean * mean, 0.0))
        return mean + sd * NORMAL.inv_cdf(min(max(self.recent / (2 * n), 1e-9), 1 - 1e-9))

    def _stamps(self) -> np.ndarray:
        return np.array([self._stamp(k) for k in range(len(self.n))])

    def _insert(self, k, t, x):
        self.n[k] += 1
        self.ls[k] += x
        self.ss[k] += x * x
        self.lst[k] += t
        self.sst[k] += float(t) * t
        self._changed(k)

    def _replace(self, k, t, x):
        self.n[k], self.ls[k], self.ss[k], self.lst[k], self.sst[k] = 1.0, x, x * x, t, float(t) * t
        self._changed(k)

    def result(self):
        if self.n is None:
            if not self.buffer:
                return []
            self._start()
        return list(zip(self.n, self.ls, self.ss, self.lst, self.sst))


def _folded(points: DataFrame, order: str, parts: int, kernels: int, horizon: int) -> DataFrame:
    at = F.pmod(F.xxhash64(order), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    dealt = points.select(at.alias("part"), F.col(order).cast("long").alias("t"), "x").repartition(parts, "part").sortWithinPartitions("part", "t")

    def run(batches):
        made: dict[int, CluStream] = {}
        for batch in batches:
            for part, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(pa.chunked_array([batch.column(2)]))):
                made.setdefault(part, CluStream(kernels, horizon)).add(t, x)
        rows = [(p, k, *s) for p, m in made.items() for k, s in enumerate(m.result())]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64())
        columns = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array([v.tolist() if isinstance(v, np.ndarray) else v for v in c], t) for c, t in zip(columns, kinds)], ["part", "kernel", "n", "ls", "ss", "lst", "sst"])

    return dealt.mapInArrow(run, KERNEL)


def clustream(points: DataFrame, order: str, kernels: int = 100, horizon: int = 1000) -> DataFrame:
    """The kernels after the last point."""
    return _folded(points, order, 1, kernels, horizon)


def _macro(kernels: DataFrame, k: int, passes: int = 10) -> DataFrame:
    # a few rows, read in each pass: folded once, as the fold is the work
    rows = checkpointed(kernels.select(F.monotonically_increasing_id().alias("id"), F.col("n").alias("weight"), F.transform("ls", lambda v: v / F.col("n")).alias("x")))
    seeds = [r.x for r in rows.orderBy(F.col("weight").desc(), F.col("x")[0]).limit(k).collect()]
    if not seeds:
        return rows.select(F.lit(0).alias("cluster"), "weight", F.lit(0).cast("long").alias("kernels"))
    return nearest(rows, lloyd(rows, seeds, passes)).groupBy("cluster").agg(F.sum("weight").alias("weight"), F.count("*").alias("kernels"))


def macro(points: DataFrame, order: str, kernels: int = 100, horizon: int = 1000, k: int = 5) -> DataFrame:
    """Macro clusters: k-means over the kernels, seeded by the heaviest."""
    return _macro(clustream(points, order, kernels, horizon), k)


def distributed(points: DataFrame, order: str, parts: int, kernels: int = 100, horizon: int = 1000, k: int = 5) -> DataFrame:
    """Local kernels of each part, then one global set of macro clusters that keeps their weights."""
    return _macro(_folded(points, order, parts, kernels, horizon), k)


def enclosing(points: np.ndarray, steps: int = 20_000) -> tuple[np.ndarray, float]:
    """Centre and radius of the smallest enclosing ball.

    The centre is the convex combination that maximises the mean squared distance less that of the
    centre; Frank-Wolfe steps towards the farthest point, or away from the nearest one in use, converge
    linearly, and the gap between the farthest point and the bound says when to stop.
    """
    points = np.unique(points, axis=0)
    share = np.zeros(len(points))
    share[0] = 1.0
    c = points[0].astype(float)
    for _ in range(steps):
        d2 = ((points - c) ** 2).sum(1)
        bound = float(share @ d2)
        far = int(d2.argmax())
        used = np.flatnonzero(share > 0)
        near = int(used[d2[used].argmin()])
        if d2[far] - bound <= 1e-12 * max(bound, 1e-300):
            break
        if d2[far] - bound >= bound - d2[near]:
            step = min((d2[far] - bound) / (2 * d2[far]), 1.0)
            share *= 1 - step
            share[far] += step
        else:
            step = (bound - d2[near]) / (2 * d2[near]) if d2[near] > 0 else np.inf
            step = min(step, share[near] / (1 - share[near])) if share[near] < 1 else 0.0
            share *= 1 + step
            share[near] = max(share[near] - step, 0.0)
            if share[near] < 1e-15:
                share[near] = 0.0
        share /= share.sum()
        c = share @ points
    return c, float(np.sqrt(((points - c) ** 2).sum(1).max()))


def balls(points: DataFrame, label: str) -> DataFrame:
    """The smallest enclosing ball of each label's points, for windows of bounded size."""
    schema = f"{label} int, n long, radius double"

    def run(pdf):
        x = np.array(pdf["x"].tolist(), float)
        _, r = enclosing(x)
        return pdf.iloc[:1].assign(n=len(pdf), radius=round(r, 4))[[label, "n", "radius"]]

    return points.select(label, "x").groupBy(label).applyInPandas(run, schema)


def _nearer(least: np.ndarray, d2: np.ndarray, labels: np.ndarray, classes: list, x: np.ndarray, y: np.ndarray) -> None:
    """Puts the squared distances of a piece into the `k` least of each row and class; `labels`, of the columns, rise.

    Products say which points are near; what is kept of them is the sum of the squared differences.
    """
    k = least.shape[2]
    for c, (low, high) in enumerate(zip(np.searchsorted(labels, classes, "left"), np.searchsorted(labels, classes, "right"))):
        if low == high:
            continue
        own = d2[:, low:high]
        rows = np.flatnonzero(own.min(1) < least[:, c, -1])
        if not len(rows):
            continue
        near = own[rows]
        exact = np.full((len(rows), k), np.inf)
        for j in range(min(k, high - low)):
            at = near.argmin(1)[:, None]
            told = np.square(x[rows] - y[low + at[:, 0]]).sum(1)
            exact[:, j] = np.where(np.isinf(np.take_along_axis(near, at, 1)[:, 0]), np.inf, told)
            np.put_along_axis(near, at, np.inf, 1)
        least[rows, c] = np.sort(np.c_[least[rows, c], exact], axis=1)[:, :k]


def connectivity(points: DataFrame, k: int = 2) -> DataFrame:
    """id, label, class, con: how well a point is tied to each class.

    Its mean distance to its `k` nearest others in the class, against the mean of that over the class's own points:
    1 up to there, and the ratio beyond.  The only point of a class is tied to it fully, and no other point is.
    """
    held = points.select("id", "x", "label")
    classes = sorted(r.label for r in held.where("label != -1").select("label").distinct().collect())  # a row a class
    if not classes:
        return held.select("id", "label", F.lit(0).alias("class"), F.lit(0.0).alias("con")).where("false")

    def nearest_of(batches):
        for same, left, right in _sides(batches):
            # by class, so that the points of a class are a run of columns
            left, right = (t.take(pa.array(np.argsort(t["label"].to_numpy(), kind="stable"))) for t in (left, right))
            ids, labels, xs = zip(*((t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["x"])) for t in (left, right)))
            least = [np.full((len(x), len(classes), k), np.inf) for x in xs]
            for i, j, d2 in _pieces(*xs):
                if same:
                    d2[_same(ids[0][i], ids[1][j])] = np.inf
                _nearer(least[0][i], d2, labels[1][j], classes, xs[0][i], xs[1][j])
                if not same:
                    _nearer(least[1][j], d2.T, labels[0][i], classes, xs[1][j], xs[0][i])
            for names, of, ds in list(zip(ids, labels, least))[: 1 if same else 2]:
                listed = pa.FixedSizeListArray.from_arrays(pa.array(ds.ravel()), len(classes) * k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(of), listed], ["id", "label", "ds"])

    kind = held.schema["label"].dataType.simpleString()
    found = _block_pairs(held).mapInArrow(nearest_of, f"id long, label {kind}, ds array<double>").groupBy("id").agg(F.first("label").alias("label"), F.collect_list("ds").alias("all"))
    # a column a class, then a row a class: the k least of what the pairs of blocks found
    own = lambda at: F.flatten(F.transform("all", lambda ds: F.slice(ds, at, k)))
    least = [F.filter(F.slice(F.array_sort(own(c * k + 1)), 1, k), lambda v: v < math.inf) for c in range(len(classes))]
    mean = lambda ds: F.aggregate(ds, F.lit(0.0), lambda s, v: s + F.sqrt(v)) / F.nullif(F.size(ds), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(int(c)).alias("class"), mean(ds).alias("d")) for c, ds in zip(classes, least))))
    near = checkpointed(found.select("id", "label", each.alias("c")).select("id", "label", "c.class", "c.d"))  # read more than once
    usual = near.where(F.col("label") == F.col("class")).groupBy("class").agg(F.avg("d").alias("usual"))
    con = F.when(F.col("usual").isNull(), (F.col("label") == F.col("class")).cast("double")).when(F.col("d") > F.col("usual"), F.col("usual") / F.col("d")).otherwise(1.0)
    return near.join(usual, "class").select("id", "label", "class", con.alias("con"))


def connections(con: DataFrame) -> DataFrame:
    """label, class, con: the mean connectivity of a class's points to each other class."""
    return con.where((F.col("label") != -1) & (F.col("label") != F.col("class"))).groupBy("label", "class").agg(F.avg("con").alias("con"))


def joined_classes(con: DataFrame, tau: float = 0.5) -> dict[int, int]:
    """Classes that are tied to each other beyond `tau` both ways count as one, named by the least: class -> name."""
    tied = {(r["label"], r["class"]): r["con"] for r in connections(con).collect()}  # classes squared
    names = {c: c for pair in tied for c in pair}

    def root(c):
        while names[c] != c:
            c = names[c]
        return c

    for (a, b), v in sorted(tied.items()):
        if a < b and min(v, tied.get((b, a), 0.0)) > tau:
            x, y = root(a), root(b)
            names[max(x, y)] = min(x, y)
    return {c: root(c) for c in names}


def cmm(points: DataFrame, clusters: list, k: int = 2) -> DataFrame:
    """Cluster mapping measure: cmm and its three costs, as shares of all connectivity.

    A found cluster stands for the class it holds most points of (the least of equals).  Points that no cluster holds,
    points whose clusters all stand for other classes, and noise within clusters cost by their connectivity.
    """
    con = connectivity(points, k)
    held = inside(points, clusters).where("cluster is not null").select("id", "label", "cluster")
    counts = held.where("label != -1").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    stands = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("class"))
    hits = held.join(stands, "cluster", "left").join(con.select("id", "class", "con"), ["id", "class"], "left")
    hits = hits.groupBy("id").agg(F.max("con").alias("best"), F.max(F.coalesce(F.col("label") == F.col("class"), F.lit(False))).alias("right"))
    own = con.where(F.col("label") == F.col("class")).select("id", F.col("con").alias("own"))
    rows = points.select("id", "label").join(own, "id", "left").join(hits, "id", "left")
    noise, best, tied = F.col("label") == -1, F.coalesce("best", F.lit(0.0)), F.coalesce("own", F.lit(1.0))
    cost = lambda when, v: F.sum(F.when(when, v).otherwise(0.0))
    sums = rows.agg(
        F.sum(F.when(noise, 1.0).otherwise(tied)).alias("top"), cost(~noise & F.col("right").isNull(), tied).alias("missed"),
        cost(~noise & (F.col("right") == F.lit(False)), tied * (1 - best)).alias("misplaced"), cost(noise, best).alias("noise"),
    )
    share = lambda v: F.coalesce(F.when(F.col("top") > 0, v / F.col("top")), F.lit(0.0))
    parts = [share(F.col(c)).alias(c) for c in ("missed", "misplaced", "noise")]
    return sums.select((1 - share(F.col("missed") + F.col("misplaced") + F.col("noise"))).alias("cmm"), *parts)


def horizons(points: DataFrame, horizon: int, kernels: int = 100, k: int = 5, parts: int = 2) -> DataFrame:
    """horizon, ssq, van_dongen, rand: macro clusters of each horizon's kernels against its points' labels.

    `points` has rn (the rank in the order), x and label.  A horizon is a bounded window, and one task's work; its
    rows are dealt in turn to `parts` local clusterers, whose kernels are clustered by k-means from the heaviest.
    """

    def run(pdf):
        pdf = pdf.sort_values("rn")
        x, labels = np.array(pdf["x"].tolist(), float), pdf["label"].to_numpy()
        local = [CluStream(kernels, horizon) for _ in range(parts)]
        for t, row in zip(pdf["rn"].tolist(), x):
            local[t % parts].add(t, row)
        made = sorted(((n, ls / n) for m in local for n, ls, *_ in m.result()), key=lambda r: (-r[0], r[1][0]))
        rows = np.array([c for _, c in made])
        centres = rows[:k]
        for _ in range(5):
            at = ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([rows[at == j].mean(0) if (at == j).any() else np.zeros(x.shape[1]) for j in range(len(centres))])
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        used = [j for j in range(len(centres)) if (at == j).any()]
        centre = np.array([x[at == j].mean(0) for j in used])
        radius = np.array([np.sqrt(x[at == j].var(0).sum()) if (at == j).sum() > 1 else 5e-5 for j in used])
        d2 = ((x[:, None] - centre[None]) ** 2).sum(2)
        within = np.sqrt(d2) <= radius
        within = np.c_[within, ~within.any(1)]
        cells = np.array([within[labels == v].sum(0) for v in np.unique(labels)], float)
        pairs = lambda c: (c * (c - 1) / 2).sum()
        n = cells.sum()
        van_dongen = (cells.max(0).sum() + cells.max(1).sum()) / (2 * n)
        rand = (pairs(n) - pairs(cells.sum(0)) - pairs(cells.sum(1)) + 2 * pairs(cells)) / pairs(n) if n > 1 else None
        return pd.DataFrame([(int(pdf["horizon"].iloc[0]), d2[labels != -1].min(1).sum(), van_dongen, rand)], columns=["horizon", "ssq", "van_dongen", "rand"])

    rows = points.withColumn("horizon", F.floor(F.col("rn") / horizon).cast("int"))
    return rows.select("horizon", "rn", "x", "label").groupBy("horizon").applyInPandas(run, "horizon int, ssq double, van_dongen double, rand double")
