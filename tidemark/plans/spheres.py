"""Queries on enclosing balls and merged spheres of the embeddings, with SQL over all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clustering as C
from tidemark.operators import spheres as S

from .clusters import found, points
from .streams import rounded

THRESHOLD, PARTS = 0.75, 7


def merged_spheres(spark, d):
    """Spheres of sevenths of each label's vectors, merged where they overlap."""
    rows = points(spark, d).withColumn("part", F.col("label") * 10 + F.col("id") % PARTS)
    out = S.merged_spheres(C.spheres_of(rows, "part"), THRESHOLD)
    return rounded(out.select("cluster", "members", F.col("centre")[0].alias("x"), "radius", "weight"), 5, "x", "radius", "weight")


def sphere_pairs(spark, d):
    """Pairs of these spheres that overlap."""
    rows = points(spark, d).withColumn("part", F.col("label") * 10 + F.col("id") % PARTS)
    return rounded(S.overlapping(C.spheres_of(rows, "part"), THRESHOLD), 5, "overlap")


def enclosing_ball(spark, d):
    """The smallest ball around each label's vectors."""
    return rounded(S.balls(points(spark, d), "label", 1e-6).select("label", "n", "radius"), 4, "radius")


def separation_of_balls(spark, d):
    """Separation of the found clusters and the labels about the middles of balls."""
    rows = points(spark, d)
    truth = C.spheres_of(rows, "label").collect()  # a row a label
    got = S.separation_of(rows, [r.asDict() for r in found(spark, d)], [r.asDict() for r in truth])
    return rounded(spark.createDataFrame([got], "bss double, bss_gt double, bss_ratio double"), 4, "bss", "bss_gt", "bss_ratio")


QUERIES = {"merged_spheres": merged_spheres, "sphere_pairs": sphere_pairs, "enclosing_ball": enclosing_ball, "separation_of_balls": separation_of_balls}

_SPHERES = f"""t as (select vec_id as id, label*10 + vec_id%{PARTS} as cluster, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), cf as (select cluster, i, count(*)::double as n, sum(v) as s, sum(v*v) as q from t group by 1, 2),
 sp as (select cluster, max(n) as w, list(s/n order by i) as c, sqrt(sum(greatest(case when q/n-(s/n)*(s/n) <= 0 and q/n-(s/n)*(s/n) > -5e-5 then 1e-50 else q/n-(s/n)*(s/n) end, 0))) as r from cf group by 1),
 d as (select a.cluster as a, b.cluster as b, list_distance(a.c, b.c) as d, a.r as r1, b.r as r2 from sp a join sp b on a.cluster < b.cluster), o as (select a, b, case when d >= r1+r2 then 0 when d+least(r1, r2) <= greatest(r1, r2) then 1 else (r1+r2-d)/(2*least(r1, r2)) end as overlap from d), l as (select * from o where overlap > {THRESHOLD})"""
SQL = {
    "sphere_pairs": f"with {_SPHERES} select a::int as a, b::int as b, round(overlap, 5) as overlap from l",
    "merged_spheres": f"with recursive {_SPHERES}, e as (select a, b from l union select b, a from l), reach as (select cluster as a, cluster as b from sp union select reach.a, e.b from reach join e on e.a = reach.b), k as (select a as cluster, min(b) as component from reach group by 1), m as (select component, i, sum(s/n*n)/sum(n) as v from cf join k using (cluster) group by 1, 2), mid as (select component, list(v order by i) as c from m group by 1) select component::int as cluster, count(*) as members, round(any_value(mid.c)[1], 5)+0.0 as x, round(max(list_distance(sp.c, mid.c)+r), 5) as radius, round(sum(w), 5) as weight from sp join k using (cluster) join mid using (component) group by 1",
}
