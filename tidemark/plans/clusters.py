"""Clustering queries on the embeddings, with their SQL.

The found clustering is the sphere of each group label % 5, the true one has a class per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clustering as C
from tidemark.operators import micro as M

from .streams import read, rounded

DIMS = 64


def points(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"), "label", (F.col("label") % 5).alias("grp"))


def found(spark, d):
    return C.spheres_of(points(spark, d), "grp").orderBy("cluster").collect()  # 5 rows


def cells(spark, d):
    return C.membership(points(spark, d), found(spark, d))


def cf_by_label(spark, d):
    f = C.features(points(spark, d), "label", F.col("id"))
    return rounded(f.select("label", "n", F.posexplode(F.arrays_zip("ls", "ss")).alias("i", "s"), "lst").select("label", "n", "i", F.col("s.ls").alias("ls"), F.col("s.ss").alias("ss"), "lst"), 4, "ls", "ss")


def cf_merge(spark, d):
    """Features by label, merged to groups, equal those of the groups."""
    f = C.features(points(spark, d), "label").withColumn("grp", F.col("label") % 5)
    m = C.merged(f.drop("label"), "grp")
    return rounded(m.select("grp", "n", F.posexplode(F.arrays_zip("ls", "ss")).alias("i", "s")).select("grp", "n", "i", F.col("s.ls").alias("ls"), F.col("s.ss").alias("ss")), 4, "ls", "ss")


def cf_radius(spark, d):
    return rounded(C.clusters_of(points(spark, d), "label").select("cluster", "weight", "radius"), 5, "radius")


def relevance(spark, d):
    f = C.features(points(spark, d), "label", F.col("id").cast("double"))
    return rounded(f.select("label", C.relevance_stamp(F.col("n"), F.col("lst"), F.col("sst"), 10).alias("stamp")), 3, "stamp")


def _first(spark, d, k=5):
    rows = points(spark, d).orderBy("id").limit(k).collect()  # the seeds
    return [r.x for r in rows]


def kmeans_assign(spark, d):
    return rounded(C.nearest(points(spark, d), _first(spark, d)).select("id", "cluster", "d2"), 5, "d2")


def kmeans_iterate(spark, d):
    p = points(spark, d)
    centres = C.lloyd(p, _first(spark, d), 2)
    return rounded(C.nearest(p, centres).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d2").alias("inertia")), 3, "inertia")


def gaussian_means(spark, d):
    """Macro clusters: k-means over the label centres, seeded by the groups' spheres."""
    micro = C.clusters_of(points(spark, d), "label")
    seeds = [r.centre for r in found(spark, d)]
    rows = micro.select(F.col("cluster").alias("id"), F.col("centre").alias("x"), "weight")
    centres = C.lloyd(rows, seeds, 1)
    return C.nearest(rows, centres).groupBy("cluster").agg(F.sum("weight").alias("weight"), F.count("*").alias("micro"))


def membership_matrix(spark, d):
    return cells(spark, d)


def ssq(spark, d):
    return rounded(C.ssq(points(spark, d), found(spark, d)), 3, "ssq")


def pair_measures(spark, d):
    return rounded(C.pair_measures(cells(spark, d)), 6, "van_dongen", "rand")


def entropy_measures(spark, d):
    out = C.entropies(cells(spark, d), 6)
    return rounded(out, 6, *out.columns)


def f1_purity(spark, d):
    return rounded(C.f1_purity(cells(spark, d)), 6, "f1_p", "purity", "f1_r")


def general(spark, d):
    return rounded(C.general(points(spark, d), found(spark, d)), 6, "precision", "recall", "redundancy")


def silhouette(spark, d):
    return rounded(C.silhouette(points(spark, d), found(spark, d)), 6, "silhouette")


def c_index(spark, d):
    return rounded(C.c_index(points(spark, d), found(spark, d)), 6, "c_index")


def separation(spark, d):
    p = points(spark, d)
    middle = [r["m"] for r in p.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]
    return rounded(C.separation(C.clusters_of(p, "grp"), C.clusters_of(p, "label"), middle, middle), 4, "bss", "bss_gt", "bss_ratio")


def sphere_overlap(spark, d):
    c = C.clusters_of(points(spark, d), "label")
    other = c.select(F.col("cluster").alias("other"), F.col("centre").alias("c2"), F.col("radius").alias("r2"))
    dist = F.sqrt(C.squared(F.col("centre"), F.col("c2")))
    out = c.join(F.broadcast(other), F.col("cluster") < F.col("other"))  # a row per label on each side
    return rounded(out.select("cluster", "other", C.overlap(dist, F.col("radius"), F.col("r2")).alias("overlap"), C.hull_distance(dist, F.col("radius"), F.col("r2")).alias("hull")), 5, "overlap", "hull")


def asof_ground_truth(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("ts"), "event_type", "user_id")
    truth = rows.where("ts % 100 = 0").select("ts", F.col("event_type").alias("truth"))
    return C.latest_before(rows.select("ts", "user_id"), truth, "ts")


def asof_irregular_truth(spark, d):
    """Truth at uneven times, off any period; the first results have none."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("ts"), "event_type", "user_id")
    truth = rows.where("ts % 7919 % 61 = 17 and ts > 40").select("ts", F.col("event_type").alias("truth"))
    out = C.latest_before(rows.where("ts % 3 = 1").select("ts", "user_id"), truth, "ts")
    return out.na.fill("none", ["truth"]).na.fill(-1, ["truth_ts"])


def clustream(spark, d):
    return M.clustream(points(spark, d), "id", kernels=20, horizon=200).select(F.col("kernel"), "n", F.round(F.col("ls")[0], 4).alias("ls0"))


def clustream_macro(spark, d):
    return M.macro(points(spark, d), "id", kernels=20, horizon=200, k=5)


def distributed_clustream(spark, d):
    return M.distributed(points(spark, d), "id", parts=2, kernels=20, horizon=200, k=5)


def cmm(spark, d):
    out = M.cmm(points(spark, d), found(spark, d))
    return rounded(out, 6, *out.columns)


def class_connections(spark, d):
    return rounded(M.connections(M.connectivity(points(spark, d))), 6, "con")


QUERIES = {
    "cf_by_label": cf_by_label, "cf_merge": cf_merge, "cf_radius": cf_radius, "cf_relevance_stamp": relevance, "kmeans_assign": kmeans_assign, "kmeans_iterate": kmeans_iterate, "gaussian_means": gaussian_means,
    "membership_matrix": membership_matrix, "ssq": ssq, "rand_van_dongen": pair_measures, "entropy_measures": entropy_measures, "f1_purity": f1_purity, "cluster_general": general, "silhouette": silhouette,
    "cindex": c_index, "bss": separation, "sphere_overlap": sphere_overlap, "asof_ground_truth": asof_ground_truth, "asof_irregular_truth": asof_irregular_truth, "clustream_kernels": clustream, "clustream_macro": clustream_macro,
    "distributed_clustream": distributed_clustream, "cmm": cmm, "class_connections": class_connections,
}

TALL = f"tall as (select vec_id as id, label, label%5 as grp, unnest(range({DIMS})) as i, unnest(embedding)::double as v from embeddings)"


def _clusters(key: str, name: str) -> str:
    return f"{name}_cf as (select {key} as cluster, i, count(*)::double as n, sum(v) as ls, sum(v*v) as ss from tall group by 1,2), {name}_v as (select *, ss/n-(ls/n)*(ls/n) as var0 from {name}_cf), {name} as (select cluster, max(n) as weight, case when max(n) <= 1 then 0 else 1.8*avg(sqrt(greatest(case when var0 <= 0 and var0 > -5e-5 then 1e-50 else var0 end,0))) end as radius from {name}_v group by 1)"


FOUND = TALL + ", fc_cf as (select grp as cluster, i, count(*)::double as n, sum(v) as ls, sum(v*v) as ss from tall group by 1,2), fc as (select cluster, max(n) as weight, sqrt(sum(greatest(case when ss/n-(ls/n)*(ls/n) <= 0 and ss/n-(ls/n)*(ls/n) > -5e-5 then 1e-50 else ss/n-(ls/n)*(ls/n) end, 0))) as radius from fc_cf group by 1), dist as (select t.id, t.label, c.cluster, sum((t.v-c.ls/c.n)*(t.v-c.ls/c.n)) as d2 from tall t join fc_cf c on c.i=t.i group by 1,2,3), held as (select dist.*, fc.radius, fc.weight from dist join fc using (cluster) where sqrt(d2) <= case when weight <= 1 then 5e-5 else radius end)"
CELLS = FOUND + ", cells as (select coalesce(h.cluster,-1) as cluster, p.label, count(*) as n from (select distinct id, label from tall) p left join held h on h.id=p.id group by 1,2), r as (select cluster, sum(n)::double as r, max(n) as m from cells group by 1), k as (select label, sum(n)::double as k, max(n) as m from cells group by 1), g as (select sum(n)::double as a, count(distinct label) as classes from cells)"
SEEDED = TALL + ", seeds as (select id, i, v, dense_rank() over (order by id)-1 as cluster from tall qualify dense_rank() over (order by id) <= 5), d0 as (select t.id, s.cluster, sum((t.v-s.v)*(t.v-s.v)) as d2 from tall t join seeds s on s.i=t.i group by 1,2), a0 as (select id, arg_min(cluster, (d2, cluster)) as cluster, min(d2) as d2 from d0 group by 1)"


_TIED = """pairs as (select a.id, a.label, b.id as id2, b.label as class, sqrt(sum((a.v-b.v)*(a.v-b.v))) as d from tall a join tall b on a.i=b.i and a.id <> b.id group by 1,2,3,4),
 near as (select id, label, class, avg(d) as d from (select *, row_number() over (partition by id, class order by d) as r from pairs) where r <= 2 group by 1,2,3),
 usual as (select class, avg(d) as u from near where label=class group by 1), con as (select id, label, class, case when d > u then u/d else 1 end as con from near join usual using (class))"""


def _pass(k: int) -> str:
    return f", c{k} as (select a.cluster, t.i, avg(t.v) as v from tall t join a{k - 1} a using (id) group by 1,2), d{k} as (select t.id, s.cluster, sum((t.v-s.v)*(t.v-s.v)) as d2 from tall t join c{k} s on s.i=t.i group by 1,2), a{k} as (select id, arg_min(cluster, (d2, cluster)) as cluster, min(d2) as d2 from d{k} group by 1)"


ERFINV = "(" + " + ".join(f"{c!r}*power(2*p-1,{2 * k + 1})" for k, c in enumerate(C._erf_inverse_terms(12))) + ")*sqrt(2)"
_E = "e as (select case when er=0 then 1 else 1-hc/er end as hom, case when ek=0 then 1 else 1-hk/ek end as com, * from (select -sum(n/a*log10(n/r))/log10(6) as hc, -sum(n/a*log10(n/k))/log10(max(classes)) as hk, -sum(n/a*log10(r/a))/log10(6) as er, -sum(n/a*log10(k/a))/log10(max(classes)) as ek, sum(n/a*log10(n/r/k*a))/log10(max(classes)) as mi from cells join r using (cluster) join k using (label), g))"
SQL = {
    "cf_by_label": f"with {TALL} select label, count(*) as n, i::int as i, round(sum(v),4)+0.0 as ls, round(sum(v*v),4) as ss, sum(id)::bigint as lst from tall group by label, i",
    "cf_merge": f"with {TALL} select grp, count(*) as n, i::int as i, round(sum(v),4)+0.0 as ls, round(sum(v*v),4) as ss from tall group by grp, i",
    "cf_radius": f"with {TALL}, {_clusters('label', 'c')} select cluster, weight, round(radius,5) as radius from c",
    "cf_relevance_stamp": f"with s as (select label, count(*) as n, avg(vec_id) as m, sqrt(greatest(sum(vec_id::double*vec_id)/count(*)-avg(vec_id)*avg(vec_id),0)) as sd, 10.0/(2*count(*)) as p from embeddings group by 1) select label, round(case when n < 20 then m else m + sd*{ERFINV} end,3) as stamp from s",
    "kmeans_assign": f"with {SEEDED} select id, cluster::int as cluster, round(d2,5) as d2 from a0",
    "kmeans_iterate": f"with {SEEDED}{_pass(1)}{_pass(2)} select cluster::int as cluster, count(*) as n, round(sum(d2),3) as inertia from a2 group by 1",
    "gaussian_means": f"with {TALL}, m as (select label as id, i, avg(v) as v, count(*) as n from tall group by 1,2), s0 as (select grp as cluster, i, avg(v) as v from tall group by 1,2), d0 as (select m.id, s.cluster, sum((m.v-s.v)*(m.v-s.v)) as d from m join s0 s using (i) group by 1,2), a0 as (select id, arg_min(cluster, (d, cluster)) as cluster from d0 group by 1), s1 as (select a0.cluster, m.i, avg(m.v) as v from m join a0 using (id) group by 1,2), d1 as (select m.id, s.cluster, sum((m.v-s.v)*(m.v-s.v)) as d from m join s1 s using (i) group by 1,2), a1 as (select id, arg_min(cluster, (d, cluster)) as cluster from d1 group by 1) select cluster::int as cluster, sum(n)::double as weight, count(*) as micro from a1 join (select distinct id, n from m) using (id) group by 1",
    "membership_matrix": f"with {CELLS} select * from cells",
    "ssq": f"with {FOUND}, m as (select id, min(d2) as d2 from dist group by 1) select round(sum(d2),3) as ssq from m",
    "rand_van_dongen": f"with {CELLS} select round(((select sum(m) from r)+(select sum(m) from k))/(2*a),6) as van_dongen, round((a*(a-1)/2-(select sum(r*(r-1)/2) from r)-(select sum(k*(k-1)/2) from k)+2*(select sum(n*(n-1)/2) from cells))/(a*(a-1)/2),6) as rand from g",
    "entropy_measures": f"with {CELLS}, {_E} select round(1-hc,6) as fc_cross_entropy, round(1-hk,6) as gt_cross_entropy, round(case when hom > 1 or hom < 0 then -1 else hom end,6) as homogeneity, round(com,6) as completeness, round(case when 2*hom*com/(hom+com) > 1 or hom < 0 then -1 else 2*hom*com/(hom+com) end,6) as v_measure, round(case when er+ek > 0 then 2*mi/(er+ek) else 1 end,6) as var_information from e",
    "f1_purity": f"with {CELLS}, f as (select cluster, label, n, n/r as p, 2*(n/r)*(n/k)/(n/r+n/k) as f1 from cells join r using (cluster) join k using (label)), b as (select cluster, arg_max(p, (n, -label)) as p, arg_max(f1, (n, -label)) as f1 from f where cluster <> -1 group by 1), c as (select label, coalesce(max(f1) filter (cluster <> -1),0) as best from f group by 1) select round((select avg(f1) from b),6) as f1_p, round((select avg(p) from b),6) as purity, round((select avg(best) from c),6) as f1_r",
    "cluster_general": f"with {FOUND}, h as (select p.id, count(held.id) as h from (select distinct id from tall) p left join held on held.id=p.id group by 1) select 1.0::double as precision, round(count(*) filter (h > 0)/count(*),6) as recall, round(count(*) filter (h > 1)/count(*),6) as redundancy, 5::int as clusters, (select count(distinct label) from tall)::int as classes from h",
    "silhouette": f"with {FOUND}, hs as (select * from held), pts as (select * from tall where id in (select id from hs)), pd as (select a.id, b.id as id2, sqrt(sum((a.v-b.v)*(a.v-b.v))) as d from pts a join pts b on a.i=b.i and a.id <> b.id group by 1,2), m as (select pd.id, h.cluster, avg(d) as d from pd join hs h on h.id=pd.id2 group by 1,2), own as (select m.id, arg_min(m.cluster, (d, m.cluster)) as cluster, min(d) as a from m join hs h on h.id=m.id and h.cluster=m.cluster group by 1), s as (select own.id, a, min(m.d) as b from own join m on m.id=own.id and m.cluster <> own.cluster group by 1,2) select round((avg((b-a)/greatest(a,b))+1)/2,6) as silhouette from s",
    "cindex": f"with {FOUND}, pd as (select h.cluster, a.id, b.id as id2, sqrt(sum((a.v-b.v)*(a.v-b.v))) as d from held h join held h2 on h.cluster=h2.cluster and h.id < h2.id join tall a on a.id=h.id join tall b on b.id=h2.id and b.i=a.i group by 1,2,3) select round((avg(d)-min(d))/(max(d)-min(d)),6) as c_index from pd",
    "bss": f"with {TALL}, m as (select i, avg(v) as m from tall group by 1), a as (select grp, i, count(*) as n, avg(v) as c from tall group by 1,2), b as (select label, i, count(*) as n, avg(v) as c from tall group by 1,2), s as (select (select sum(n*(c-m)*(c-m)) from a join m using (i)) as bss, (select sum(n*(c-m)*(c-m)) from b join m using (i)) as gt) select round(bss,4) as bss, round(gt,4) as bss_gt, round(bss/gt,4) as bss_ratio from s",
    "sphere_overlap": f"with {TALL}, {_clusters('label', 'c')}, d as (select a.cluster, b.cluster as other, sqrt(sum((a.ls/a.n-b.ls/b.n)*(a.ls/a.n-b.ls/b.n))) as d from c_cf a join c_cf b on a.i=b.i and a.cluster < b.cluster group by 1,2), x as (select d.*, c1.radius as r1, c2.radius as r2 from d join c c1 using (cluster) join c c2 on c2.cluster=d.other) select cluster, other, round(case when d >= r1+r2 then 0 when d+least(r1,r2) <= greatest(r1,r2) then 1 else (r1+r2-d)/(2*least(r1,r2)) end,5)+0.0 as overlap, round(greatest(d-r1-r2,0),5)+0.0 as hull from x",
    "asof_ground_truth": "with t as (select event_id as ts, event_type as truth from events where event_id % 100 = 0), r as (select event_id as ts, user_id from events) select r.ts, r.user_id, t.truth, t.ts as truth_ts from r asof left join t on r.ts >= t.ts",
    "class_connections": f"with {TALL}, {_TIED} select label, class, round(avg(con),6) as con from con where label <> class group by 1,2",
    "cmm": f"with {FOUND}, {_TIED}, n as (select h.cluster, p.label, count(*) as n from held h join (select distinct id, label from tall) p using (id) group by 1,2), st as (select cluster, arg_max(label, (n, -label)) as class from n group by 1), hits as (select h.id, max(con.con) as best, bool_or(con.label = st.class) as right_ from held h join st using (cluster) join con on con.id = h.id and con.class = st.class group by 1), r as (select con.id, con.con as own, best, right_ from con left join hits using (id) where con.label = con.class), s as (select sum(own) as top, coalesce(sum(own) filter (right_ is null),0) as missed, coalesce(sum(own*(1-best)) filter (not right_),0) as misplaced from r) select round(1-(missed+misplaced)/top,6) as cmm, round(missed/top,6) as missed, round(misplaced/top,6) as misplaced, 0.0::double as noise from s",
    "asof_irregular_truth": "with t as (select event_id as ts, event_type as truth from events where event_id % 7919 % 61 = 17 and event_id > 40), r as (select event_id as ts, user_id from events where event_id % 3 = 1) select r.ts, r.user_id, coalesce(t.truth, 'none') as truth, coalesce(t.ts, -1) as truth_ts from r asof left join t on r.ts >= t.ts",
}
