"""Cluster features, k-means, and clustering measures over a window of points.

Points are rows (id, x: array<double>, label), clusters rows (cluster, centre, radius, weight).  A
clustering is a small table; it is compiled into array literals, so points never shuffle to meet it.
Pairwise measures (silhouette, C index) compare blocks of points as matrix products, one pair of blocks at a
time, and only sums per point or cluster leave a task; they are quadratic by nature, and meant for horizons.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import latest

RADIUS_FACTOR, TINY = 1.8, 1e-50
#: From this inclusion on a point counts as inside.
INSIDE = 0.8


def features(points: DataFrame, key: str, ts: Column | None = None) -> DataFrame:
    """Additive features of each group: n, sums, sums of squares (arrays) and those of the time stamps."""
    dims = points.select(F.col(key), F.posexplode("x").alias("i", "v")).groupBy(key, "i").agg(F.count("*").alias("n"), F.sum("v").alias("ls"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda s: s[c])
    out = dims.groupBy(key).agg(F.max("n").alias("n"), by("ls").alias("ls"), by("ss").alias("ss"))
    if ts is not None:
        out = out.join(points.groupBy(key).agg(F.sum(ts).alias("lst"), F.sum(ts * ts).alias("sst")), key)
    return out


def merged(cfs: DataFrame, key: str) -> DataFrame:
    """Features of the unions of features that share a key."""
    tall = cfs.select(key, "n", F.posexplode(F.arrays_zip("ls", "ss")).alias("i", "s")).groupBy(key, "i").agg(F.sum("n").alias("n"), F.sum("s.ls").alias("ls"), F.sum("s.ss").alias("ss"))
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda s: s[c])
    return tall.groupBy(key).agg(F.max("n").alias("n"), by("ls").alias("ls"), by("ss").alias("ss"))


def centre(n: Column, ls: Column) -> Column:
    return F.transform(ls, lambda v: v / n)


def variances(n: Column, ls: Column, ss: Column) -> Column:
    """Per dimension; what rounding has made slightly negative or zero is tiny, never zero."""

    def one(s, q):
        v = q / n - (s / n) * (s / n)
        return F.when((v <= 0) & (v > -5e-5), TINY).otherwise(v)

    return F.zip_with(ls, ss, one)


def radius(n: Column, ls: Column, ss: Column) -> Column:
    """1.8 times the mean standard deviation; 0 for a single point."""
    sds = F.transform(variances(n, ls, ss), lambda v: F.sqrt(F.greatest(v, F.lit(0.0))))
    return F.when(n <= 1, 0.0).otherwise(RADIUS_FACTOR * F.aggregate(sds, F.lit(0.0), lambda a, v: a + v) / F.size(sds))


def inclusion(distance: Column, r: Column, n: Column) -> Column:
    """1 inside the radius, else 0; a single point includes what is within 5e-5."""
    return (distance <= F.when(n <= 1, 5e-5).otherwise(r)).cast("double")


def relevance_stamp(n: Column, lst: Column, sst: Column, m: int) -> Column:
    """The mean time of a cluster, or the m-th youngest point's if its times are normal."""
    mean = lst / n
    sd = F.sqrt(F.greatest(sst / n - mean * mean, F.lit(0.0)))
    return F.when(n < 2 * m, mean).otherwise(mean + sd * normal_quantile(F.lit(float(m)) / (2 * n)))


def normal_quantile(p: Column) -> Column:
    """Odd series of the inverse error function at 2p - 1, times sqrt 2."""
    z = 2 * p - 1
    x, term, out = z * z, z, F.lit(0.0)
    for c in _erf_inverse_terms(12):
        out, term = out + c * term, term * x
    return out * math.sqrt(2)


def _erf_inverse_terms(n: int) -> list[float]:
    """c_k / (2k + 1) * (sqrt(pi) / 2)^(2k + 1) with the usual recurrence of c."""
    c = [1.0]
    for k in range(1, n):
        c.append(sum(c[m] * c[k - 1 - m] / ((m + 1) * (2 * m + 1)) for m in range(k)))
    return [v / (2 * k + 1) * (math.sqrt(math.pi) / 2) ** (2 * k + 1) for k, v in enumerate(c)]


def squared(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def literal(rows: list) -> Column:
    """Clusters as one constant, an array of structs: cluster, centre, radius, weight."""
    told = [{"cluster": int(r["cluster"]), "centre": [float(v) for v in r["centre"]], "radius": float(r["radius"]), "weight": float(r["weight"])} for r in rows]
    return F.from_json(F.lit(json.dumps(told)), "array<struct<cluster: int, centre: array<double>, radius: double, weight: double>>")


def clusters_of(points: DataFrame, key: str) -> DataFrame:
    f = features(points, key)
    n, ls, ss = F.col("n"), F.col("ls"), F.col("ss")
    return f.select(F.col(key).cast("int").alias("cluster"), centre(n, ls).alias("centre"), radius(n, ls, ss).alias("radius"), n.cast("double").alias("weight"))


def spheres_of(points: DataFrame, key: str) -> DataFrame:
    """Spheres whose radius is the root mean squared distance of their points from the centre."""
    f = features(points, key)
    n, ls, ss = F.col("n"), F.col("ls"), F.col("ss")
    spread = F.sqrt(F.aggregate(variances(n, ls, ss), F.lit(0.0), lambda a, v: a + F.greatest(v, F.lit(0.0))))
    return f.select(F.col(key).cast("int").alias("cluster"), centre(n, ls).alias("centre"), spread.alias("radius"), n.cast("double").alias("weight"))


def nearest(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Adds `cluster`, the first of the nearest centres, and `d2`, the squared distance."""
    made = F.from_json(F.lit(json.dumps([[float(v) for v in c] for c in centres])), "array<array<double>>")
    out = points.withColumn("_d", F.transform(made, lambda c: squared(F.col("x"), c)))
    return out.withColumn("d2", F.array_min("_d")).withColumn("cluster", (F.array_position("_d", F.col("d2")) - 1).cast("int")).drop("_d")


def lloyd(points: DataFrame, centres: list[list[float]], passes: int) -> list[list[float]]:
    """Fixed passes of k-means; an empty cluster moves to the origin."""
    dims = len(centres[0])
    for _ in range(passes):
        moved = features(nearest(points, centres), "cluster")
        new = {r["cluster"]: [v / r["n"] for v in r["ls"]] for r in moved.collect()}  # k rows
        centres = [new.get(k, [0.0] * dims) for k in range(len(centres))]
    return centres


def inside(points: DataFrame, clusters: list) -> DataFrame:
    """A row per point and cluster that includes it (cluster null, d2 null for uncovered points)."""
    near = F.transform(literal(clusters), lambda c: F.struct(c["cluster"].alias("cluster"), squared(F.col("x"), c["centre"]).alias("d2"), c["radius"].alias("radius"), c["weight"].alias("weight")))
    hit = F.filter(near, lambda c: inclusion(F.sqrt(c["d2"]), c["radius"], c["weight"]) > INSIDE)
    return points.withColumn("c", F.explode_outer(hit)).withColumns({"cluster": F.col("c.cluster"), "d2": F.col("c.d2")}).drop("c")


def max_inclusion(points: DataFrame, clusters: list) -> DataFrame:
    """Adds `inclusion`: the largest that any cluster gives a point (0 without clusters)."""
    each = F.transform(literal(clusters), lambda c: inclusion(F.sqrt(squared(F.col("x"), c["centre"])), c["radius"], c["weight"]))
    return points.withColumn("inclusion", F.coalesce(F.array_max(each), F.lit(0.0)))


def membership(points: DataFrame, clusters: list) -> DataFrame:
    """(cluster, label, n); the uncovered points are cluster -1, a point may be in several."""
    return inside(points, clusters).groupBy(F.coalesce("cluster", F.lit(-1)).alias("cluster"), "label").agg(F.count("*").alias("n"))


def ssq(points: DataFrame, clusters: list) -> DataFrame:
    """Sum of the squared distances to the nearest centre; noise (label -1) does not count."""
    d2 = F.array_min(F.transform(literal(clusters), lambda c: squared(F.col("x"), c["centre"])))
    return points.where("label != -1").agg(F.sum(d2).alias("ssq"))


def pair_measures(cells: DataFrame) -> DataFrame:
    """Van Dongen's and Rand's measures of a membership table."""
    two = lambda c: c * (c - 1) / 2
    rows = cells.groupBy("cluster").agg(F.sum("n").alias("s"), F.max("n").alias("m")).agg(F.sum(two(F.col("s"))).alias("m1"), F.sum("m").alias("best_cluster"), F.sum("s").alias("n"))
    columns = cells.groupBy("label").agg(F.sum("n").alias("s"), F.max("n").alias("m")).agg(F.sum(two(F.col("s"))).alias("m2"), F.sum("m").alias("best_class"))
    both = cells.agg(F.sum(two(F.col("n"))).alias("m"))
    out = rows.crossJoin(columns).crossJoin(both)  # one row each
    m = two(F.col("n"))
    return out.select(((F.col("best_cluster") + F.col("best_class")) / (2 * F.col("n"))).alias("van_dongen"), ((m - F.col("m1") - F.col("m2") + 2 * F.col("m")) / m).alias("rand"))


def _cells(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy("cluster").agg(F.sum("n").alias("r"))
    columns = cells.groupBy("label").agg(F.sum("n").alias("k"))
    return cells.join(rows, "cluster").join(columns, "label")


def entropies(cells: DataFrame, clusters: int) -> DataFrame:
    """Cross entropies, homogeneity, completeness, V measure and shared information; -1 where undefined.
    `clusters` counts the uncovered one."""
    full = _cells(cells)
    total = cells.agg(F.sum("n").alias("all"), F.countDistinct("label").alias("classes"))
    share = F.col("n") / F.col("all")
    sums = full.crossJoin(F.broadcast(total)).groupBy("all", "classes").agg(
        *((-F.sum(share * F.log10(F.col(x) / F.col(y)))).alias(name) for name, x, y in (("hc", "n", "r"), ("hk", "n", "k"), ("er", "r", "all"), ("ek", "k", "all"))),
        F.sum(share * F.log10(F.col("n") / F.col("r") / F.col("k") * F.col("all"))).alias("mi"),
    )
    by_clusters, by_classes = F.log10(F.lit(float(clusters))), F.log10(F.col("classes").cast("double"))
    unit = lambda v, by: F.when(by > 0, v / by).otherwise(v)
    fc, gt, fx, gx = unit(F.col("er"), by_clusters), unit(F.col("ek"), by_classes), unit(F.col("hc"), by_clusters), unit(F.col("hk"), by_classes)
    hom, com = F.when(fc == 0, 1.0).otherwise(1 - fx / fc), F.when(gt == 0, 1.0).otherwise(1 - gx / gt)
    v = 2 * hom * com / (hom + com)
    info = F.when(fc + gt > 0, 2 * unit(F.col("mi"), by_classes) / (fc + gt)).otherwise(1.0)
    return sums.select((1 - fx).alias("fc_cross_entropy"), (1 - gx).alias("gt_cross_entropy"), F.when((hom > 1) | (hom < 0), -1.0).otherwise(hom).alias("homogeneity"), com.alias("completeness"), F.when((v > 1) | (hom < 0), -1.0).otherwise(v).alias("v_measure"), info.alias("var_information"))


def f1_purity(cells: DataFrame) -> DataFrame:
    """F1 of each cluster's main class, purity, and the best F1 of each class; uncovered points make no cluster."""
    full = _cells(cells).where("label != -1")
    precision, recall = F.col("n") / F.col("r"), F.col("n") / F.col("k")
    full = full.withColumns({"precision": precision, "f1": 2 * precision * recall / (precision + recall)})
    found = full.where("cluster != -1").groupBy("cluster").agg(F.max_by(F.struct("precision", "f1"), F.struct("n", -F.col("label"))).alias("b")).agg(F.avg("b.f1").alias("f1_p"), F.avg("b.precision").alias("purity"))
    classes = full.groupBy("label").agg(F.coalesce(F.max(F.when(F.col("cluster") != -1, F.col("f1"))), F.lit(0.0)).alias("best")).agg(F.avg("best").alias("f1_r"))
    return found.crossJoin(classes)  # one row each


def general(points: DataFrame, clusters: list) -> DataFrame:
    """Precision and recall of coverage, redundancy, and the numbers of clusters and classes."""
    hits = F.size(F.filter(literal(clusters), lambda c: inclusion(F.sqrt(squared(F.col("x"), c["centre"])), c["radius"], c["weight"]) >= INSIDE))
    real = F.col("label") != -1
    one = points.select(real.alias("real"), hits.alias("h"), "label").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("h") > 0, 1)).alias("covered"), F.count(F.when((F.col("h") > 0) & F.col("real"), 1)).alias("true"), F.count(F.when(F.col("h") > 1, 1)).alias("twice"),
        F.count(F.when(F.col("real"), 1)).alias("reals"), F.countDistinct(F.when(F.col("real"), F.col("label"))).alias("classes"),
    )
    return one.select(F.when(F.col("covered") > 0, F.col("true") / F.col("covered")).otherwise(0.0).alias("precision"), (F.col("true") / F.col("reals")).alias("recall"), (F.col("twice") / F.col("n")).alias("redundancy"), F.lit(len(clusters)).alias("clusters"), F.col("classes").cast("int").alias("classes"))


#: Points in a block of the pairwise measures: the least, and the most; and how many blocks there are in between.
BLOCK, MOST, BLOCKS = 1024, 65_536, 16
#: Points of a piece of a block: a matrix product is a piece against a piece.
PIECE = 512


def _block_pairs(held: DataFrame) -> DataFrame:
    """A partition for every pair of blocks, without the mirrored ones: pair, side and the points' columns.

    A point goes to each pair of its block.  Blocks grow with the points up to `MOST`, so the number of pairs, and how
    often a point is copied, stay as they are; a task holds two blocks.  Both sides of a pair of a block with itself are
    the same points.
    """
    n = held.count()
    blocks = max(1, min(BLOCKS, math.ceil(n / BLOCK)), math.ceil(n / MOST))
    own = held.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    pair = (low * blocks - low * (low - 1) / 2 + high - low).cast("int")
    side = F.when(F.col("_own") == F.col("_other"), -1).otherwise((F.col("_own") > F.col("_other")).cast("int"))
    dealt = own.select(pair.alias("pair"), side.alias("side"), *held.columns)
    return dealt.repartitionById(blocks * (blocks + 1) // 2, F.col("pair"))


def _sides(batches):
    """Of each pair of blocks: whether it is a block with itself, and the columns of the left and of the right side."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    pairs = table["pair"].to_numpy()
    for pair in np.unique(pairs):
        rows = table.filter(pa.array(pairs == pair))
        side = rows["side"].to_numpy()
        both = [rows.filter(pa.array((side == s) | (side == -1))).drop_columns(["pair", "side"]) for s in (0, 1)]
        if all(t.num_rows for t in both):
            yield bool((side == -1).any()), *both


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal lengths as the rows of a matrix."""
    return pa.compute.list_flatten(column).to_numpy().reshape(len(column), -1)


def _members(column: pa.ChunkedArray, names: list) -> np.ndarray:
    """1.0 where the sets of a column hold a name."""
    out = np.zeros((len(column), len(names)))
    rows = pa.compute.list_parent_indices(column).to_numpy()
    held = pa.compute.list_flatten(column).to_numpy()
    for k, c in enumerate(names):
        out[rows[held == c], k] = 1.0
    return out


def _runs(side: pa.Table, names: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(clusters they are in, ids, points) of the points that are in the same clusters."""
    sets, at = np.unique(_members(side["own"], names), axis=0, return_inverse=True)
    ids, x = side["id"].to_numpy(), _matrix(side["x"])
    return [(own, ids[at == k], x[at == k]) for k, own in enumerate(sets)]


def _same(ids: np.ndarray, ids2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of equal ids."""
    by = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids[by], ids2, "left"), np.searchsorted(ids[by], ids2, "right")
    n = high - low
    return by[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], np.repeat(np.arange(len(ids2)), n)


def _pieces(x: np.ndarray, y: np.ndarray):
    """(rows, columns, squared distances) of each piece of x with each piece of y."""
    middle = y.mean(0)  # about the middle, so that little is lost in the differences
    x, y = x - middle, y - middle
    left = np.c_[-2 * x, (x * x).sum(1), np.ones(len(x))]
    right = np.c_[y, np.ones(len(y)), (y * y).sum(1)]
    for j in range(0, len(y), PIECE):
        for i in range(0, len(x), PIECE):
            d2 = left[i : i + PIECE] @ right[j : j + PIECE].T
            yield slice(i, i + PIECE), slice(j, j + PIECE), np.maximum(d2, 0.0, out=d2)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    middle = y.mean(0)  # about the middle, so that little is lost in the differences
    x, y = x - middle, y - middle
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0.0))


def silhouette(points: DataFrame, clusters: list) -> DataFrame:
    """Mean over covered points of (other - own) / max, moved to [0, 1]; noise (label -1) is nobody's neighbour."""
    held = inside(points, clusters).where("cluster is not null").groupBy("id").agg(F.first("x").alias("x"), F.first("label").alias("label"), F.collect_set("cluster").alias("own"))
    names = [r["cluster"] for r in clusters]

    def sums(batches):
        for same, left, right in _sides(batches):
            ids, ids2 = left["id"].to_numpy(), right["id"].to_numpy()
            owns = [_members(t["own"], names) for t in (left, right)]
            members = [own * (t["label"].to_numpy() != -1)[:, None] for own, t in zip(owns, (left, right))]
            totals = [np.zeros(own.shape) for own in owns]
            for i, j, d in _pieces(_matrix(left["x"]), _matrix(right["x"])):
                np.sqrt(d, out=d)
                if same:
                    d[_same(ids[i], ids2[j])] = 0.0
                else:
                    totals[1][j] += d.T @ members[0][i]
                totals[0][i] += d @ members[1][j]
            counts = [m.sum(0)[None, :] - (own if same else 0) for m, own in ((members[1], members[0]), (members[0], members[1]))]
            for names_of, t, total, n in list(zip((ids, ids2), (left, right), totals, counts))[: 1 if same else 2]:
                n = np.broadcast_to(n, total.shape)
                listed = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(v).ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(names_of), t["own"].combine_chunks(), listed(total), listed(n)], ["id", "own", "total", "n"])

    found = _block_pairs(held.select("id", "x", "label", "own")).mapInArrow(sums, "id long, own array<int>, total array<double>, n array<double>")
    each = [F.sum(F.get(c, k)).alias(f"{c}{k}") for c in ("total", "n") for k in range(len(names))]
    mean = found.groupBy("id").agg(F.first("own").alias("own"), *each)
    told = F.array(*(F.when(F.col(f"n{k}") > 0, F.struct((F.col(f"total{k}") / F.col(f"n{k}")).alias("d"), F.lit(int(c)).alias("cluster"))) for k, c in enumerate(names)))
    best = mean.select("own", F.array_sort(F.filter(told, lambda s: s.isNotNull())).alias("all"))
    best = best.select("all", F.get(F.filter("all", lambda s: F.array_contains("own", s["cluster"])), 0).alias("a")).where("a is not null")
    rest = F.get(F.filter("all", lambda s: s["cluster"] != F.col("a.cluster")), 0)["d"]
    s = best.withColumn("b", rest).where("b is not null").select(((F.col("b") - F.col("a.d")) / F.greatest("b", F.col("a.d"))).alias("s"))
    return s.agg(((F.coalesce(F.avg("s"), F.lit(0.0)) + 1) / 2).alias("silhouette"))


def separation(clusters: DataFrame, truth: DataFrame, middle: list[float], middle_truth: list[float]) -> DataFrame:
    """Weighted squared distances of the centres from the middle, of both clusterings, and their ratio."""
    far = lambda df, m, name: df.agg(F.sum(F.col("weight") * squared(F.col("centre"), F.array(*(F.lit(float(v)) for v in m)))).alias(name))
    return far(clusters, middle, "bss").crossJoin(far(truth, middle_truth, "bss_gt")).withColumn("bss_ratio", F.col("bss") / F.col("bss_gt"))


def c_index(points: DataFrame, clusters: list) -> DataFrame:
    """Where the mean distance within clusters lies between the least and the largest; a pair in two clusters counts twice."""
    held = inside(points, clusters).where("cluster is not null").groupBy("id").agg(F.first("x").alias("x"), F.collect_set("cluster").alias("own"))
    names = [r["cluster"] for r in clusters]

    def sums(batches):
        for same, left, right in _sides(batches):
            n = total = 0.0
            low, high = math.inf, -math.inf
            # points of one set of clusters against those of another: all of these pairs count equally often, or none does
            for own, ids, x in _runs(left, names):
                for own2, ids2, y in _runs(right, names):
                    often = float(own @ own2)
                    for i, j, d in _pieces(x, y) if often else ():
                        np.sqrt(d, out=d)
                        itself = _same(ids[i], ids2[j]) if same else ([], [])
                        d[itself] = 0.0
                        n, total, high = n + often * (d.size - len(itself[0])), total + often * d.sum(), max(high, d.max())
                        d[itself] = math.inf
                        low = min(low, d.min())
            n, total = (n / 2, total / 2) if same else (n, total)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (n, total, low, high)], ["n", "total", "low", "high"])

    d = _block_pairs(held).mapInArrow(sums, "n double, total double, low double, high double")
    low, high = F.min("low"), F.max("high")
    return d.agg(F.when(high > low, (F.sum("total") / F.sum("n") - low) / (high - low)).otherwise(0.0).alias("c_index"))


def overlap(distance: Column, r1: Column, r2: Column) -> Column:
    """How far two spheres overlap, 0 apart to 1 one within the other."""
    return F.when(distance >= r1 + r2, 0.0).when(distance + F.least(r1, r2) <= F.greatest(r1, r2), 1.0).otherwise((r1 + r2 - distance) / (2 * F.least(r1, r2)))


def hull_distance(distance: Column, r1: Column, r2: Column) -> Column:
    return F.greatest(distance - r1 - r2, F.lit(0.0))


def combined(c1: Column, r1: Column, w1: Column, c2: Column, r2: Column, w2: Column) -> tuple[Column, Column, Column]:
    """(centre, radius, weight) of the sphere that takes the place of two: the weighted centre, and a radius that reaches
    as far as the larger of both, or half way around them if that is more."""
    w = w1 + w2
    centre = F.zip_with(c1, c2, lambda a, b: (a * w1 + b * w2) / w)
    return centre, F.greatest(r1, r2, (r1 + r2 + F.sqrt(squared(c1, c2))) / 2), w


def latest_before(results: DataFrame, truth: DataFrame, ts: str) -> DataFrame:
    """Joins each result to the newest ground truth at or before it (null where there is none)."""
    return latest(results, truth.withColumn("truth_ts", F.col(ts)), ts, ["truth", "truth_ts"])
