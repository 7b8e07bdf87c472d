"""Synthetic streams, stateless per row: any partition makes any row of them.

Uniform numbers come from a digest of (seed, row, name), so a stream is the same for any partitioning.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_uniform
from tidemark.operators.ordered import running


def uniform(name: str, seed: int, idx: str = "idx") -> Column:
    return hash_uniform(F.lit(str(seed)), F.col(idx).cast("string"), F.lit(name))


def tree_of(tree_seed: int = 1, classes: int = 2, nominals: int = 5, numerics: int = 5, values: int = 5, max_depth: int = 5, first_leaf: int = 3, leaf_share: float = 0.15):
    """A random decision tree: ("class", name), ("nominal", column, {value: child}) or ("numeric", column, cut, below, rest).

    A nominal attribute is asked for once on a path; a numeric one is cut within what is left of its range.
    """
    rng = random.Random(tree_seed)

    def grow(depth: int, free: list[int], low: dict[int, float], high: dict[int, float]):
        if depth >= max_depth or not free and not numerics or depth >= first_leaf and rng.random() < leaf_share:
            return "class", f"class{rng.randrange(classes) + 1}"
        pick = rng.randrange(len(free) + numerics)
        if pick < len(free):
            rest = [x for x in free if x != free[pick]]
            return "nominal", f"nominal{free[pick] + 1}", {f"value{v + 1}": grow(depth + 1, rest, low, high) for v in range(values)}
        a = pick - len(free)
        cut = low.get(a, 0.0) + rng.random() * (high.get(a, 1.0) - low.get(a, 0.0))
        below = grow(depth + 1, free, low, high | {a: cut})
        return "numeric", f"numeric{a + 1}", cut, below, grow(depth + 1, free, low | {a: cut}, high)

    return grow(0, list(range(nominals)), {}, {})


def _label(tree) -> Column:
    if tree[0] == "class":
        return F.lit(tree[1])
    if tree[0] == "numeric":
        return F.when(F.col(tree[1]) < tree[2], _label(tree[3])).otherwise(_label(tree[4]))
    out = F
    for value, child in tree[2].items():
        out = out.when(F.col(tree[1]) == value, _label(child))
    return out


def random_tree(spark: SparkSession, n: int, tree_seed: int = 1, seed: int = 1, classes: int = 2, nominals: int = 5, numerics: int = 5, values: int = 5, max_depth: int = 5, first_leaf: int = 3, leaf_share: float = 0.15) -> DataFrame:
    """Rows labelled by a random decision tree: idx, nominal1.., numeric1.., class (1-based names)."""
    rows = spark.range(n).withColumnRenamed("id", "idx")
    cols = {f"nominal{k + 1}": F.concat(F.lit("value"), (F.floor(uniform(f"n{k}", seed) * values) + 1).cast("string")) for k in range(nominals)}
    cols |= {f"numeric{k + 1}": uniform(f"x{k}", seed) for k in range(numerics)}
    return rows.withColumns(cols).withColumn("class", _label(tree_of(tree_seed, classes, nominals, numerics, values, max_depth, first_leaf, leaf_share)))


def hyperplane(spark: SparkSession, n: int, seed: int = 1, attributes: int = 10, drifting: int = 2, change: float = 0.0, noise: float = 0.05, turn: float = 0.1) -> DataFrame:
    """Rows on either side of a hyperplane: idx, att1.., class.  With `change` the first weights move by it
    each row and turn round with probability `turn`; the running weights are prefix sums."""
    rows = spark.range(n).withColumnRenamed("id", "idx").withColumns({f"att{k + 1}": uniform(f"x{k}", seed) for k in range(attributes)})
    weights = [hash_uniform(F.lit(str(seed)), F.lit("w"), F.lit(str(k))) for k in range(attributes)]
    if change:
        rows = running(rows, "idx", {f"t{k}": (uniform(f"t{k}", seed) < turn).cast("long") for k in range(drifting)})
        rows = running(rows, "idx", {f"m{k}": F.when(F.col(f"t{k}") % 2 == 0, change).otherwise(-change) for k in range(drifting)}, before=True)
        weights[:drifting] = [w + F.col(f"m{k}") for k, w in enumerate(weights[:drifting])]
    total = lambda cs: sum(cs[1:], cs[0])
    above = total([w * F.col(f"att{k + 1}") for k, w in enumerate(weights)]) >= 0.5 * total(weights)
    flipped = above != (uniform("noise", seed) < noise)
    return rows.select("idx", *(f"att{k + 1}" for k in range(attributes)), F.when(flipped, "class2").otherwise("class1").alias("class"))


class RandomRBF:
    """Spheres that move along straight lines and are reflected at the walls of the unit cube.

    Every `speed` rows a sphere moves one `step`.  With `events`, a sphere comes or goes every `every`
    rows, within `k` plus or minus `span`.  Noise is spread evenly and has the label after the last.
    """

    def __init__(self, seed: int = 1, k: int = 5, span: int = 3, dims: int = 2, radius: float = 0.07, noise: float = 0.1, speed: int = 10, step: float = 0.002, events: bool = False, every: int = 30_000):
        rng = random.Random(seed)
        self.seed, self.k, self.span, self.dims, self.radius, self.noise = seed, k, span, dims, radius, noise
        self.speed, self.step, self.events, self.every = speed, step, events, every
        self.most = k + span if events else k
        self.starts = [[rng.uniform(radius, 1 - radius) for _ in range(dims)] for _ in range(self.most)]
        ways = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(self.most)]
        self.ways = [[v / sum(x * x for x in w) ** 0.5 for v in w] for w in ways]

    def _active(self, idx: Column) -> Column:
        """Spheres that are there: a triangle wave around k."""
        if not self.events or not self.span:
            return F.lit(self.k)
        phase = F.floor(idx / self.every) % (4 * self.span)
        s = self.span
        return (F.lit(self.k) + F.when(phase <= s, phase).when(phase <= 3 * s, 2 * s - phase).otherwise(phase - 4 * s)).cast("int")

    def _place(self, k: int, j: int, idx: Column) -> Column:
        """Reflected motion: the remainder of the way in a corridor of twice the width."""
        low, width = self.radius, 1 - 2 * self.radius
        way = (self.starts[k][j] - low) + self.ways[k][j] * self.step * F.floor(idx / self.speed)
        rest = F.pmod(way, F.lit(2 * width))
        return low + F.when(rest <= width, rest).otherwise(2 * width - rest)

    def rows(self, spark: SparkSession, n: int) -> DataFrame:
        """idx, att1.., class (0-based; the number of spheres, at most, for noise)."""
        out = spark.range(n).withColumnRenamed("id", "idx")
        is_noise = uniform("noise", self.seed) < self.noise
        which = F.floor(uniform("which", self.seed) * self._active(F.col("idx"))).cast("int")
        out = out.withColumns({"_k": which, "_noise": is_noise, "_r": F.pow(uniform("r", self.seed), 1.0 / self.dims) * self.radius})
        gauss = [F.sqrt(-2 * F.log(1 - uniform(f"g{j}", self.seed))) * F.cos(6.283185307179586 * uniform(f"h{j}", self.seed)) for j in range(self.dims)]
        out = out.withColumns({f"_g{j}": g for j, g in enumerate(gauss)})
        size = F.sqrt(sum((F.col(f"_g{j}") * F.col(f"_g{j}") for j in range(1, self.dims)), F.col("_g0") * F.col("_g0")))
        for j in range(self.dims):
            home = F.lit(0.0)
            for k in range(self.most):
                home = F.when(F.col("_k") == k, self._place(k, j, F.col("idx"))).otherwise(home)
            out = out.withColumn(f"att{j + 1}", F.when(F.col("_noise"), uniform(f"u{j}", self.seed)).otherwise(home + F.col("_r") * F.col(f"_g{j}") / size))
        return out.select("idx", *(f"att{j + 1}" for j in range(self.dims)), F.when(F.col("_noise"), self.most).otherwise(F.col("_k")).alias("class"))

    def truth(self, spark: SparkSession, n: int, every: int = 1000) -> DataFrame:
        """The spheres after each `every` rows: idx, cluster, centre, radius."""
        out = spark.range(0, n, every).withColumnRenamed("id", "idx").withColumn("cluster", F.explode(F.sequence(F.lit(0), self._active(F.col("idx")) - 1)))
        places = []
        for j in range(self.dims):
            home = F.lit(0.0)
            for k in range(self.most):
                home = F.when(F.col("cluster") == k, self._place(k, j, F.col("idx"))).otherwise(home)
            places.append(home)
        return out.select("idx", "cluster", F.array(*places).alias("centre"), F.lit(self.radius).alias("radius"))

    def changes(self, spark: SparkSession, n: int) -> DataFrame:
        """When spheres come and go: idx, type, message."""
        out = spark.range(self.every, max(n, self.every), self.every).withColumnRenamed("id", "idx")
        diff = self._active(F.col("idx")) - self._active(F.col("idx") - 1)
        out = out.withColumn("diff", diff).where("diff != 0")
        return out.select("idx", F.when(F.col("diff") > 0, "create").otherwise("delete").alias("type"), F.format_string("%d clusters", self._active(F.col("idx"))).alias("message"))
