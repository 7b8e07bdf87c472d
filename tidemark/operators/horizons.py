"""Clustering measures over a sliding horizon: at every sample those of the last points, from statistics of panes.

The order is cut into panes of `every` points; a sample stands after each pane, and its horizon is the last `panes` of them.
What a measure needs is either additive over panes (cells of clusters and classes, squared distances, counts of coverage) or over
pairs of panes (sums of distances to each cluster's points, nearest distances to each class's).  A pane's or a pair's
statistics are made once and serve all samples whose horizons hold them, so a new sample costs its newest pane, and the pairs
of that with the panes of its horizon.  Points are copied to 2 `panes` - 1 pairs at most, however long the table; a task holds
one pair of panes at a time.

Points are rows with x, label and the order; a clustering is a small table of spheres (see `clustering`).  Which clusters hold a point
is found when it arrives.  Noise has label -1.  Measures of nothing are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.storage import kept

from .clustering import INSIDE, _distances, inclusion, literal, squared
from .ordered import numbered

#: Measures by what they are made from.
CELLS = ["van_dongen", "rand", "fc_cross_entropy", "gt_cross_entropy", "homogeneity", "completeness", "v_measure", "var_information", "f1_p", "purity", "f1_r"]
COUNTS = ["ssq", "precision", "recall", "redundancy"]
PAIRS = ["silhouette", "c_index"]
MEASURES = [*CELLS, *COUNTS, *PAIRS]


def paned(points: DataFrame, order: str, every: int, clusters: list, **more: Column) -> DataFrame:
    """pane, rn, x, label, own (the clusters that hold a point), d2 (to the nearest centre), and `more`, made from x; written once."""
    near = F.transform(literal(clusters), lambda c: F.struct(c["cluster"].alias("cluster"), squared(F.col("x"), c["centre"]).alias("d2"), c["radius"].alias("radius"), c["weight"].alias("weight")))
    hit = F.filter("near", lambda c: inclusion(F.sqrt(c["d2"]), c["radius"], c["weight"]) > INSIDE)
    rows = numbered(points.select(F.col(order).alias("at"), "x", F.col("label").cast("int").alias("label")), "at").withColumn("near", near)
    rows = rows.select(F.floor(F.col("rn") / every).cast("int").alias("pane"), "rn", "x", "label", F.transform(hit, lambda c: c["cluster"]).alias("own"), F.array_min(F.transform("near", lambda c: c["d2"])).alias("d2"), *(c.alias(n) for n, c in more.items()))
    return kept(rows, "panes")


def to_samples(df: DataFrame, first: Column, last: Column, end: int) -> DataFrame:
    """Each row once for every sample from `first` to `last` that there is."""
    return df.withColumn("sample", F.explode(F.sequence(first, F.least(last, F.lit(end)))))


def _grouped(df: DataFrame, panes: int, end: int, keys: list[str], sums: list[str]) -> DataFrame:
    return to_samples(df, F.col("pane"), F.col("pane") + panes - 1, end).groupBy("sample", *keys).agg(*(F.sum(c).alias(c) for c in sums))


def cells_of(rows: DataFrame, panes: int, end: int) -> DataFrame:
    """sample, cluster (-1: none), label, n."""
    each = rows.select("pane", "label", F.explode_outer("own").alias("cluster")).groupBy("pane", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "label").agg(F.count("*").alias("n"))
    return _grouped(each, panes, end, ["cluster", "label"], ["n"])


def counts_of(rows: DataFrame, panes: int, end: int) -> DataFrame:
    """sample and the sums that coverage and squared distances are made from."""
    real, hits = F.col("label") != -1, F.size("own")
    one = lambda c: F.count(F.when(c, 1))
    each = rows.groupBy("pane").agg(F.count("*").alias("all"), one(hits > 0).alias("covered"), one((hits > 0) & real).alias("true"), one(hits > 1).alias("twice"), one(real).alias("reals"), F.sum(F.when(real, F.col("d2"))).alias("d2"))
    return _grouped(each, panes, end, [], ["all", "covered", "true", "twice", "reals", "d2"])


def count_measures(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.select("sample", F.col("d2").alias("ssq"), F.coalesce(share("true", "covered"), F.lit(0.0)).alias("precision"), share("true", "reals").alias("recall"), share("twice", "all").alias("redundancy"))


def cell_measures(cells: DataFrame, clusters: int) -> DataFrame:
    """All measures of the cells of each sample; `clusters` does not count the uncovered one."""
    by = lambda *c: W.partitionBy("sample", *c)
    full = cells.withColumns({"r": F.sum("n").over(by("cluster")), "k": F.sum("n").over(by("label")), "all": F.sum("n").over(by()), "top_r": F.max("n").over(by("cluster")), "top_k": F.max("n").over(by("label"))})
    # each row and column of the table counts once, by the share of it that a cell is
    per = lambda value, whole: F.sum(value * F.col("n") / F.col(whole))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    share = F.col("n") / F.col("all")
    log = lambda x, y: F.log10(F.col(x) / F.col(y))
    sums = full.groupBy("sample").agg(
        F.first("all").alias("all"), F.countDistinct("label").alias("classes"), per(two("r"), "r").alias("m1"), per(two("k"), "k").alias("m2"), F.sum(two("n")).alias("both"),
        per(F.col("top_r"), "r").alias("best_r"), per(F.col("top_k"), "k").alias("best_k"), *((-F.sum(share * log(x, y))).alias(c) for c, x, y in (("hc", "n", "r"), ("hk", "n", "k"), ("er", "r", "all"), ("ek", "k", "all"))),
        F.sum(share * F.log10(F.col("n") / F.col("r") / F.col("k") * F.col("all"))).alias("mi"),
    )
    pairs = F.col("all") * (F.col("all") - 1) / 2
    by_clusters, by_classes = F.log10(F.lit(clusters + 1.0)), F.log10(F.col("classes").cast("double"))
    unit = lambda v, b: F.when(b > 0, v / b).otherwise(v)
    fc, gt, fx, gx = unit(F.col("er"), by_clusters), unit(F.col("ek"), by_classes), unit(F.col("hc"), by_clusters), unit(F.col("hk"), by_classes)
    hom, com = F.when(fc == 0, 1.0).otherwise(1 - fx / fc), F.when(gt == 0, 1.0).otherwise(1 - gx / gt)
    v = F.when(hom + com != 0, 2 * hom * com / (hom + com)).otherwise(0.0)
    out = sums.select(
        "sample", ((F.col("best_r") + F.col("best_k")) / (2 * F.col("all"))).alias("van_dongen"), F.when(pairs > 0, (pairs - F.col("m1") - F.col("m2") + 2 * F.col("both")) / pairs).alias("rand"),
        (1 - fx).alias("fc_cross_entropy"), (1 - gx).alias("gt_cross_entropy"), F.when((hom > 1) | (hom < 0), -1.0).otherwise(hom).alias("homogeneity"), com.alias("completeness"),
        F.when((v > 1) | (hom < 0), -1.0).otherwise(v).alias("v_measure"), F.when(fc + gt > 0, 2 * unit(F.col("mi"), by_classes) / (fc + gt)).otherwise(1.0).alias("var_information"),
    )
    precision, recall = F.col("n") / F.col("r"), F.col("n") / F.col("k")
    real = full.where("label != -1").withColumns({"precision": precision, "f1": 2 * precision * recall / (precision + recall)})
    found = real.where("cluster != -1").groupBy("sample", "cluster").agg(F.max_by(F.struct("precision", "f1"), F.struct("n", -F.col("label"))).alias("b")).groupBy("sample").agg(F.avg("b.f1").alias("f1_p"), F.avg("b.precision").alias("purity"))
    classes = real.groupBy("sample", "label").agg(F.coalesce(F.max(F.when(F.col("cluster") != -1, F.col("f1"))), F.lit(0.0)).alias("best")).groupBy("sample").agg(F.avg("best").alias("f1_r"))
    return out.join(found, "sample", "left").join(classes, "sample", "left")


#: What a pair of panes gives: sums of distances by point and cluster (part sum), nearest distances by point and class (part near), sums over pairs of points in one cluster (part all).
PAIRED = "part string, low int, high int, rn long, cluster int, n double, total double, least double, most double, ds array<double>"


def pair_statistics(rows: DataFrame, panes: int, names: list[int], classes: list[int] = (), near: int = 0, parts: tuple = ("sum", "all")) -> DataFrame:
    """Statistics of every pair of panes that share a horizon; `near` distances to each of `classes` are kept."""
    copied = rows.withColumn("_away", F.explode(F.sequence(F.lit(1 - panes), F.lit(panes - 1)))).withColumn("_other", F.col("pane") + F.col("_away")).where("_other >= 0")
    dealt = copied.select(F.least("pane", "_other").alias("low"), F.greatest("pane", "_other").alias("high"), "pane", "rn", "x", "label", "own")

    def compared(group: pa.Table) -> pa.Table:
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        group = group.sort_by([("pane", "ascending"), ("rn", "ascending")]).combine_chunks()
        first = group["pane"].to_numpy() == low
        if low != high and (first.all() or not first.any()):
            return _paired([], low, high)
        width = len(group["x"][0])
        x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        rn, label = group["rn"].to_numpy(), group["label"].to_numpy()
        member = np.array([[c in own for c in names] for own in group["own"].to_pylist()], float).reshape(len(rn), len(names))
        covered, real = member.any(1), label != -1
        d = _distances(x[first], x[~first] if low != high else x)
        out, same = [], low == high
        sides = [(first, ~first if not same else first, d)] + ([] if same else [(~first, first, d.T)])
        for one, two, dist in sides:
            other = np.ones_like(dist) if not same else 1.0 - np.eye(len(dist))
            if "sum" in parts:
                seen = covered[one][:, None] * covered[two][None, :] * other
                weights = member[two] * real[two][:, None]
                total, n = (dist * seen) @ weights, seen @ weights
                i, k = np.nonzero(n)
                out.append({"part": "sum", "rn": rn[one][i], "cluster": np.array(names, np.int32)[k], "n": n[i, k], "total": total[i, k]})
            if near:
                hidden = np.where(other > 0, dist, np.inf)
                for c in classes:
                    of = np.sort(hidden[:, label[two] == c], axis=1)[:, :near]
                    at = np.flatnonzero(np.isfinite(of[:, :1]).any(1)) if of.shape[1] else []
                    if len(at):
                        out.append({"part": "near", "rn": rn[one][at], "cluster": np.full(len(at), c), "ds": [r[np.isfinite(r)].tolist() for r in of[at]]})
        if "all" in parts:
            one, two, dist = sides[0]
            together = sum(np.outer(member[one][:, k], member[two][:, k]) for k in range(len(names)))
            together = np.triu(together, 1) if same else together
            at = together > 0 if len(names) else np.zeros_like(dist, bool)
            if at.any():
                out.append({"part": "all", "n": [together.sum()], "total": [(dist * together).sum()], "least": [dist[at].min()], "most": [dist[at].max()]})
        return _paired(out, low, high)

    return dealt.groupBy("low", "high").applyInArrow(compared, PAIRED)


_KINDS = {"part": pa.string(), "low": pa.int32(), "high": pa.int32(), "rn": pa.int64(), "cluster": pa.int32(), "n": pa.float64(), "total": pa.float64(), "least": pa.float64(), "most": pa.float64(), "ds": pa.list_(pa.float64())}


def _paired(found: list[dict], low: int, high: int) -> pa.Table:
    tables = []
    for f in found:
        n = len(next(v for k, v in f.items() if k != "part"))
        told = f | {"part": [f["part"]] * n, "low": [low] * n, "high": [high] * n}
        tables.append(pa.table([pa.array(told[c], kind) if c in told else pa.nulls(n, kind) for c, kind in _KINDS.items()], names=list(_KINDS)))
    return pa.concat_tables(tables) if tables else pa.schema(list(_KINDS.items())).empty_table()


def over_samples(paired: DataFrame, panes: int, end: int) -> DataFrame:
    """Each pair's statistics at every sample whose horizon holds both panes."""
    return to_samples(paired, F.col("high"), F.col("low") + panes - 1, end)


def silhouettes(paired: DataFrame, rows: DataFrame, panes: int, end: int) -> DataFrame:
    """sample, silhouette: the mean over covered points of (other - own) / max, moved to [0, 1]."""
    mean = over_samples(paired.where("part = 'sum'"), panes, end).groupBy("sample", "rn", "cluster").agg((F.sum("total") / F.sum("n")).alias("d"))
    mean = mean.join(rows.select("rn", "own"), "rn").withColumn("mine", F.array_contains("own", F.col("cluster")))
    best = mean.groupBy("sample", "rn").agg(F.min(F.when(F.col("mine"), F.struct("d", "cluster"))).alias("a"), F.sort_array(F.collect_list(F.struct("d", "cluster"))).alias("all"))
    rest = F.get(F.filter("all", lambda s: s["cluster"] != F.col("a.cluster")), 0)["d"]
    s = best.where("a is not null").withColumn("b", rest).where("b is not null").select("sample", ((F.col("b") - F.col("a.d")) / F.greatest("b", F.col("a.d"))).alias("s"))
    return s.groupBy("sample").agg(((F.avg("s") + 1) / 2).alias("silhouette"))


def c_indexes(paired: DataFrame, panes: int, end: int) -> DataFrame:
    """sample, c_index: where the mean distance within clusters lies between the least and the largest."""
    low, high = F.min("least"), F.max("most")
    found = over_samples(paired.where("part = 'all'"), panes, end).groupBy("sample")
    return found.agg(F.when(high > low, (F.sum("total") / F.sum("n") - low) / (high - low)).otherwise(0.0).alias("c_index"))


def evaluated(points: DataFrame, order: str, clusters: list, every: int, panes: int, measures: list[str]) -> DataFrame:
    """sample, measure, value: every chosen measure at every sample (the pane it stands after, from 0)."""
    if unknown := set(measures) - set(MEASURES):
        raise ValueError(f"no measures {sorted(unknown)}; there are {MEASURES}")
    rows = paned(points, order, every, clusters)
    end = rows.agg(F.max("pane")).first()[0]
    if end is None:
        return rows.sparkSession.createDataFrame([], "sample int, measure string, value double")
    out = rows.sparkSession.range(end + 1).select(F.col("id").cast("int").alias("sample"))
    if set(measures) & set(CELLS):
        out = out.join(cell_measures(cells_of(rows, panes, end), len(clusters)), "sample", "left")
    if set(measures) & set(COUNTS):
        out = out.join(count_measures(counts_of(rows, panes, end)), "sample", "left")
    if set(measures) & set(PAIRS):
        parts = tuple(p for p, m in (("sum", "silhouette"), ("all", "c_index")) if m in measures)
        paired = kept(pair_statistics(rows, panes, [r["cluster"] for r in clusters], parts=parts), "pairs")
        for name, made in (("silhouette", lambda: silhouettes(paired, rows, panes, end)), ("c_index", lambda: c_indexes(paired, panes, end))):
            out = out.join(made(), "sample", "left") if name in measures else out
    told = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))
    return out.select("sample", told.alias("m")).select("sample", "m.measure", "m.value")
