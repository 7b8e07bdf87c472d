"""Sufficient statistics, naive Bayes and split criteria, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import gaussian_pdf, hoeffding_bound, normal_cdf


def long_form(df: DataFrame, attributes: list[str], keep: list[str]) -> DataFrame:
    """A row per attribute: keep..., attribute, value (double); missing values are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("value")) for a in attributes)))
    return df.select(*keep, pairs.alias("p")).select(*keep, "p.attribute", "p.value").where("value is not null")


def gaussian_observers(df: DataFrame, attributes: list[str], y: str) -> DataFrame:
    """Per attribute and class: count, mean, sample variance (0 for one row), minimum and maximum."""
    rows = long_form(df, attributes, [y])
    return rows.groupBy("attribute", y).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.greatest(F.coalesce(F.var_samp("value"), F.lit(0.0)), F.lit(0.0)).alias("variance"), F.min("value").alias("low"), F.max("value").alias("high"))


def weighted_gaussian(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Per group: weight, mean and variance (by weight less one; 0 up to a weight of one); rows without value or positive weight do not count."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (w > 0)).select(*keys, v.alias("_v"), w.alias("_w"))
    sums = rows.groupBy(*keys).agg(F.sum("_w").alias("weight"), F.sum(F.col("_w") * F.col("_v")).alias("s"), F.sum(F.col("_w") * F.col("_v") * F.col("_v")).alias("q"))
    return sums.select(*keys, "weight", (F.col("s") / F.col("weight")).alias("mean"), _weighted_variance(F.col("q") - F.col("s") * F.col("s") / F.col("weight")))


def _weighted_variance(squares: Column) -> Column:
    return F.when(F.col("weight") > 1, F.greatest(squares, F.lit(0.0)) / (F.col("weight") - 1)).otherwise(0.0).alias("variance")


def merged_gaussian(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Weight, mean and variance of the unions of groups that share the keys."""
    w, m = F.col("weight"), F.col("mean")
    within = F.when(w > 1, F.col("variance") * (w - 1)).otherwise(0.0)
    sums = parts.groupBy(*keys).agg(F.sum(w).alias("weight"), F.sum(w * m).alias("s"), F.sum(within + w * m * m).alias("q"))
    return sums.select(*keys, "weight", (F.col("s") / F.col("weight")).alias("mean"), _weighted_variance(F.col("q") - F.col("s") * F.col("s") / F.col("weight")))


def nominal_counts(df: DataFrame, attributes: list[str], y: str) -> DataFrame:
    """Contingency of each attribute's values with the class; missing values are a row of their own."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes)))
    return df.select(y, pairs.alias("p")).select(y, "p.attribute", "p.value").groupBy("attribute", "value", y).agg(F.count("*").alias("n"))


def class_priors(df: DataFrame, y: str) -> DataFrame:
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select(y, "n", (F.col("n") / F.col("all")).alias("prior"))


class NaiveBayes:
    """Gaussian naive Bayes whose model is a few numbers per class, compiled to Columns.

    The vote of a class is its log prior, the log densities of the values, and the log of one plus the
    densities at 0; a class without statistics for an attribute counts 1e-20 for it.
    """

    def __init__(self, attributes: list[str]):
        self.attributes = attributes

    def fit(self, df: DataFrame, y: str) -> NaiveBayes:
        stats = gaussian_observers(df, self.attributes, y).collect()  # classes x attributes rows
        self.classes = sorted({r[y] for r in stats})
        counts = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
        self.priors = {c: counts[c] / sum(counts.values()) for c in self.classes}
        self.stats = {(r["attribute"], r[y]): (r["mean"], r["variance"] ** 0.5) for r in stats}
        return self

    def votes(self) -> list[Column]:
        out = []
        for c in self.classes:
            vote, prototype = F.log(F.lit(self.priors[c])), F.lit(1.0)
            for a in self.attributes:
                if (a, c) in self.stats:
                    mean, sd = map(F.lit, self.stats[a, c])
                    density = F.coalesce(gaussian_pdf(F.col(a).cast("double"), mean, sd), F.lit(1.0))
                    vote += F.when(density > 0, F.log(density)).otherwise(-1e308)
                    prototype += gaussian_pdf(F.lit(0.0), mean, sd)
                else:
                    vote += F.log(F.lit(1e-20))
            out.append(F.greatest(vote + F.log(prototype), F.lit(-1e308)))
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `pred`, the class of the largest vote (the first among equals)."""
        votes = self.votes()
        best = F.greatest(*votes)
        out = F.lit(None).cast("string")
        for c, v in reversed(list(zip(self.classes, votes))):
            out = F.when(v == best, F.lit(c)).otherwise(out)
        return df.withColumn("pred", out)


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def kappa(cells: DataFrame) -> DataFrame:
    """Rows, accuracy and kappa from a confusion table, which is read once."""
    n, none = F.col("n"), F.lit(0).cast("long")
    row = F.struct(F.col("actual").alias("c"), n.alias("r"), none.alias("p"), F.when(F.col("actual") == F.col("predicted"), n).otherwise(none).alias("hit"))
    column = F.struct(F.col("predicted").alias("c"), none.alias("r"), n.alias("p"), none.alias("hit"))
    sides = cells.select(F.explode(F.array(row, column)).alias("s")).groupBy("s.c").agg(F.sum("s.r").alias("r"), F.sum("s.p").alias("p"), F.sum("s.hit").alias("hit"))
    sums = sides.agg(F.sum("r").alias("n"), F.sum("hit").alias("hits"), F.sum(F.when(F.col("c").isNotNull(), F.col("r") * F.col("p")).otherwise(0)).alias("chance"))
    p0, pc = F.col("hits") / n, F.col("chance") / (n * n)
    return sums.select("n", p0.alias("accuracy"), F.when(pc < 1, (p0 - pc) / (1 - pc)).alias("kappa"))


# --- splits.  A table of (keys..., branch, class, weight) describes candidate splits. ---


def _entropy_of(cells: DataFrame, keys: list[str]) -> DataFrame:
    """weight and entropy (bits) of each group of class weights."""
    w = F.sum("weight")
    return cells.groupBy(*keys).agg(w.alias("weight"), (F.log2(w) - F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.log2("weight")).otherwise(0.0)) / w).alias("bits"))


def info_gain(cells: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Gain of each split; null (for minus infinity) unless two branches have over 1 % of the weight."""
    cells = cells.where("weight > 0")
    whole = F.sum("weight").over(W.partitionBy(*keys))
    branches = _entropy_of(cells, [*keys, "branch"]).withColumn("w", whole)
    after = branches.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("bits")).alias("after"), F.count(F.when(F.col("weight") > 0.01 * F.col("w"), 1)).alias("large"), F.first("w").alias("w"))
    before = _entropy_of(cells.groupBy(*keys, y).agg(F.sum("weight").alias("weight")), keys).select(*keys, "bits")
    return after.join(before, keys).select(*keys, F.when(F.col("large") >= 2, F.col("bits") - F.col("after") / F.col("w")).alias("merit"))


def gini(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One minus the weighted impurity after the split."""
    w = F.sum("weight")
    branch = cells.groupBy(*keys, "branch").agg(w.alias("weight"), (1 - F.sum(F.col("weight") * F.col("weight")) / (w * w)).alias("impurity"))
    return branch.groupBy(*keys).agg((1 - F.sum(F.col("weight") * F.col("impurity")) / F.sum("weight")).alias("merit"))


def info_gain_multilabel(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy summed over labels, each of which is on with its share or off."""
    p = F.col("weight") / F.col("w")
    bits = -(F.when(p > 0, p * F.log2(p)).otherwise(0.0) + F.when(p < 1, (1 - p) * F.log2(1 - p)).otherwise(0.0))
    totals = cells.groupBy(*keys).agg(F.sum("weight").alias("w"))
    return cells.join(totals, keys).groupBy(*keys).agg(F.sum(bits).alias("bits"))


def hoeffding_decision(merits: DataFrame, n: Column, value_range: Column, delta: float, tie: float) -> DataFrame:
    """Best and second merit (0, the null split, at least) over the rows, the bound, and whether to split."""
    top = merits.where("merit is not null").agg(F.sort_array(F.collect_list("merit"), False).alias("m"))  # a row per attribute
    best, second = F.coalesce(F.get("m", 0), F.lit(0.0)), F.greatest(F.coalesce(F.get("m", 1), F.lit(0.0)), F.lit(0.0))
    eps = hoeffding_bound(value_range, delta, n)
    return top.select(best.alias("best"), second.alias("second"), eps.alias("epsilon"), ((best > 0) & ((best - second > eps) | (eps < tie))).alias("split"))


#: Ranges that the values of an attribute are cut into, so that no task holds all of them.
RANGES = 64


def _below(at: DataFrame, sums: list[str]) -> DataFrame:
    """Per attribute and value: l_<sum> over the values up to it, and a_<sum> over all; `at` has a row per attribute and value."""
    whole = at.groupBy("attribute").agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)]).alias("cuts"), *(F.sum(c).alias(f"a_{c}") for c in sums))
    rows = at.join(F.broadcast(whole), "attribute")  # a row per attribute, of fixed size
    rows = rows.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    before = W.partitionBy("attribute").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy("attribute", "range").agg(*(F.sum(c).alias(c) for c in sums))
    base = base.select("attribute", "range", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"b_{c}") for c in sums))
    up = W.partitionBy("attribute", "range").orderBy("value")
    rows = rows.withColumns({f"l_{c}": F.sum(c).over(up) for c in sums}).join(base, ["attribute", "range"])
    return rows.select("attribute", "value", *((F.col(f"l_{c}") + F.col(f"b_{c}")).alias(f"l_{c}") for c in sums), *(f"a_{c}" for c in sums))


def numeric_cuts(df: DataFrame, attributes: list[str], y: str, classes: list) -> DataFrame:
    """Exact class weights at or below (l_<k>) and above (r_<k>) every value of each attribute."""
    rows = long_form(df, attributes, [y])
    names = [str(k) for k in range(len(classes))]
    at = rows.groupBy("attribute", "value").agg(*(F.sum((F.col(y) == c).cast("double")).alias(k) for k, c in zip(names, classes)))
    return _below(at, names).select("attribute", "value", *(f"l_{k}" for k in names), *((F.col(f"a_{k}") - F.col(f"l_{k}")).alias(f"r_{k}") for k in names))


def cut_info_gain(cuts: DataFrame, classes: int) -> DataFrame:
    """Adds the information gain of each cut."""

    def bits(parts: list[Column]) -> Column:
        w = sum(parts[1:], parts[0])
        return F.when(w > 0, F.log2(w) - sum((F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in parts[1:]), F.when(parts[0] > 0, parts[0] * F.log2(parts[0])).otherwise(0.0)) / w).otherwise(0.0)

    left, right = ([F.col(f"{s}_{k}") for k in range(classes)] for s in "lr")
    wl, wr = (sum(x[1:], x[0]) for x in (left, right))
    gain = bits([a + b for a, b in zip(left, right)]) - (wl * bits(left) + wr * bits(right)) / (wl + wr)
    return cuts.withColumn("merit", F.when((wl > 0.01 * (wl + wr)) & (wr > 0.01 * (wl + wr)), gain))


def best_by(df: DataFrame, group: str, merit: str, ties: list[str], rows: int = 1) -> DataFrame:
    """The rows of largest merit in each group, with their rank."""
    order = W.partitionBy(group).orderBy(F.col(merit).desc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)


def regression_cuts(df: DataFrame, attributes: list[str], y: str) -> DataFrame:
    """Per value of each attribute: n, sum and sum of squares of the target at or below, and of all."""
    rows = long_form(df.withColumn("_y", F.col(y).cast("double")), attributes, ["_y"])
    at = rows.groupBy("attribute", "value").agg(F.count("*").cast("double").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"))
    return _below(at, list("nsq")).select("attribute", "value", *(F.col(f"{side}_{c}").alias(f"{side}{c}") for side in "la" for c in "nsq"))


def _spread(n: Column, s: Column, q: Column) -> Column:
    return F.greatest((q - s * s / n) / n, F.lit(0.0))


def variance_reduction(cuts: DataFrame, root: bool = False, least: float = 5, share: float = 0.0) -> DataFrame:
    """Adds the reduction of variance, or with `root` of standard deviation; null if a branch is too small."""
    n, s, q = (F.col(f"a{c}") for c in "nsq")
    ln, ls, lq = (F.col(f"l{c}") for c in "nsq")
    rn = n - ln
    of = (lambda *x: F.sqrt(_spread(*x))) if root else _spread
    merit = of(n, s, q) - ln / n * of(ln, ls, lq) - rn / n * of(rn, s - ls, q - lq)
    enough = (ln >= least) & (rn >= least) & (ln >= share * n) & (rn >= share * n)
    return cuts.withColumn("merit", F.when(enough, merit))


def gaussian_cuts(observers: DataFrame, y: str, candidates: int = 10) -> DataFrame:
    """Equal-width candidates inside each attribute's range with the class weights that normal
    distributions put at or below and above them."""
    span = observers.groupBy("attribute").agg(F.min("low").alias("from"), F.max("high").alias("to"))
    cut = F.col("from") + (F.col("to") - F.col("from")) * F.col("k") / (candidates + 1)
    spread = span.select("*", F.explode(F.sequence(F.lit(1), F.lit(candidates))).alias("k")).withColumn("cut", cut)
    sd = F.sqrt("variance")
    below = F.when(F.col("cut") < F.col("low"), 0.0).when(F.col("cut") >= F.col("high"), F.col("n")).otherwise(F.col("n") * F.when(sd > 0, normal_cdf((F.col("cut") - F.col("mean")) / sd)).otherwise((F.col("cut") >= F.col("mean")).cast("double")))
    return observers.join(spread, "attribute").withColumn("below", below).select("attribute", "k", "cut", y, "below", (F.col("n") - below).alias("above"))
