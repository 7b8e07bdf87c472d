"""Spheres from many points without a task that holds them: enclosing balls by core-sets, and the merging of spheres that overlap.

A ball's core-set is a few of its points.  A round is one aggregate over the points, which finds the point of each group that lies
farthest from the centre of its core-set's smallest ball; it joins the core-set.  The core-set's ball is no larger than the
group's, and the farthest point bounds that from above, so the gap of both says when to stop; all groups go on together, and only
those whose gap is still open are looked at.

Spheres that overlap lie within two radii of each other.  They are hashed to the cells of a grid as wide as the largest sphere over
their first coordinates; a sphere meets those of its own and the neighbouring cells, and what overlaps beyond the threshold is merged by
connected components.

Defined results: groups with a null key and points without coordinates are left out; a group of one point has radius 0; the radius of
merged spheres reaches around all of them from their weighted centre; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import kept

from .clustering import overlap, squared
from .micro import enclosing

#: Groups whose centres may be broadcast; those of more are joined by shuffle.
BROADCAST_ROWS = 10_000


def balls(points: DataFrame, key: str, gap: float = 1e-3, rounds: int = 500) -> DataFrame:
    """key, n, centre, radius (which holds all points), least: no enclosing ball's radius is below it, and radius <= least * (1 + gap)."""
    spark = points.sparkSession
    rows = kept(points.where(F.col(key).isNotNull() & (F.size("x") > 0)).select(F.col(key).alias("key"), "x"), "balls")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n long, centre array<double>, radius double, least double"
    first = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("x")).collect()  # a row a group
    sizes, core = {r.key: r.n for r in first}, {r.key: np.array([r.x], float) for r in first}
    found = {k: (c[0], 0.0) for k, c in core.items()}
    done: dict = {}
    for _ in range(rounds):
        if not found:
            break
        centres = spark.createDataFrame([(k, c.tolist()) for k, (c, _) in found.items()], f"key {kind}, centre array<double>")
        met = rows.join(F.broadcast(centres) if len(found) <= BROADCAST_ROWS else centres, "key")
        d2 = squared(F.col("x"), F.col("centre"))
        far = met.select("key", "x", d2.alias("d2")).groupBy("key").agg(F.max_by("x", F.struct("d2", "x")).alias("x"), F.max("d2").alias("d2")).collect()
        for r in far:
            centre, least = found[r.key]
            if math.sqrt(r.d2) <= least * (1 + gap):
                done[r.key] = (centre, math.sqrt(r.d2), least)
                del found[r.key]
                continue
            core[r.key] = np.vstack([core[r.key], r.x])
            found[r.key] = enclosing(core[r.key])
    if found:
        raise RuntimeError(f"{len(found)} balls did not close within {rounds} rounds")
    return spark.createDataFrame([(k, sizes[k], c.tolist(), r, low) for k, (c, r, low) in done.items()], schema).withColumnRenamed("key", key)


def separation_of(points: DataFrame, clusters: list, truth: list, gap: float = 1e-3) -> dict[str, float | None]:
    """bss, bss_gt and bss_ratio: weighted squared distances of the centres from the middle of a ball.

    The found clusters' middle is that of the ball around all points, the truth's that of the ball around its centres.
    """
    ball = balls(points.withColumn("_all", F.lit(0)), "_all", gap).first()
    if ball is None:
        return {"bss": None, "bss_gt": None, "bss_ratio": None}
    spread = lambda of, middle: float(sum(c["weight"] * ((np.array(c["centre"]) - middle) ** 2).sum() for c in of))
    bss, gt = spread(clusters, np.array(ball.centre)), spread(truth, enclosing(np.array([c["centre"] for c in truth], float))[0]) if truth else 1.0
    return {"bss": bss, "bss_gt": gt, "bss_ratio": bss / gt if gt else None}


def overlapping(spheres: DataFrame, threshold: float, dims: int = 2) -> DataFrame:
    """a, b (a < b), overlap: pairs of spheres that overlap beyond `threshold` (0 to 1, above 0 at least)."""
    largest = spheres.agg(F.max("radius")).first()[0]
    if largest is None:
        return spheres.select(F.col("cluster").alias("a"), F.col("cluster").alias("b"), F.lit(0.0).alias("overlap"))
    width = 2 * largest or 1.0
    cells = F.transform(F.slice("centre", 1, dims), lambda v: F.floor(v / width))
    own = spheres.select("cluster", "centre", "radius", cells.alias("cell"))
    away = F.array(*(F.array(*map(F.lit, step)) for step in itertools.product((-1, 0, 1), repeat=dims)))
    near = own.withColumn("_away", F.explode(away)).withColumn("cell", F.zip_with("cell", F.slice("_away", 1, F.size("cell")), lambda c, s: c + s))
    left = own.select(F.col("cluster").alias("a"), F.col("centre").alias("c1"), F.col("radius").alias("r1"), "cell")
    right = near.select(F.col("cluster").alias("b"), F.col("centre").alias("c2"), F.col("radius").alias("r2"), "cell")
    met = left.join(right, "cell").where("a < b").dropDuplicates(["a", "b"])
    far = F.sqrt(squared(F.col("c1"), F.col("c2")))
    return met.select("a", "b", overlap(far, F.col("r1"), F.col("r2")).alias("overlap")).where(F.col("overlap") > threshold)


def joined(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: the least node that links (a, b) lead to; labels are passed on and shortened until they stand still."""
    both = kept(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = kept(nodes.select("node", F.col("node").alias("component")), "labels")
    for _ in range(rounds):
        seen = both.join(now.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        told = now.join(seen, "node", "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("was"))
        # a label's own label is shorter still
        short = told.join(told.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", F.least("component", "next").alias("component"), "was")
        moved = kept(short, "labels")
        now = moved.drop("was")
        if moved.where("component != was").isEmpty():
            return now
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def merged_spheres(spheres: DataFrame, threshold: float) -> DataFrame:
    """cluster (the least of those merged), members, centre, radius, weight."""
    held = kept(spheres.select("cluster", "centre", "radius", "weight"), "spheres")
    named = joined(held.select(F.col("cluster").alias("node")), overlapping(held, threshold)).select(F.col("node").alias("cluster"), "component")
    rows = held.join(named, "cluster")
    dims = rows.select("component", "weight", F.posexplode("centre").alias("i", "v")).groupBy("component", "i").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
    centres = dims.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("middle"))
    out = rows.join(centres, "component").groupBy("component").agg(F.count("*").alias("members"), F.first("middle").alias("centre"), F.max(F.sqrt(squared(F.col("centre"), F.col("middle"))) + F.col("radius")).alias("radius"), F.sum("weight").alias("weight"))
    return out.select(F.col("component").alias("cluster"), "members", "centre", "radius", "weight")
