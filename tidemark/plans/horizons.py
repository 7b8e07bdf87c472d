"""Clustering measures at every sample of a sliding horizon, on the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clustering as C
from tidemark.operators import horizons as H
from tidemark.operators import mapping

from .clusters import FOUND, found, points
from .streams import rounded

EVERY, PANES = 50, 3


def horizon_measures(spark, d):
    """All measures over the last PANES * EVERY vectors, after every EVERY vectors."""
    out = H.evaluated(points(spark, d), "id", found(spark, d), EVERY, PANES, H.MEASURES)
    return rounded(out, 5, "value")


def cluster_mapping(spark, d):
    """The eight outputs of the mapping measure at every sample; the truth is the sphere of each label's vectors."""
    rows = points(spark, d)
    truth = C.spheres_of(rows, "label").orderBy("cluster").collect()  # a row a label
    out = mapping.cluster_mapping(rows, "id", found(spark, d), truth, EVERY, PANES)
    return rounded(out, 6, *mapping.OUTPUTS)


QUERIES = {"horizon_measures": horizon_measures, "cluster_mapping_by_horizon": cluster_mapping}

#: The points of each sample's horizon; which clusters hold them; the table of clusters and classes with its margins.
_WINDOW = f"""pts as (select id, any_value(label) as label, (row_number() over (order by id)-1)//{EVERY} as pane from tall group by id), samples as (select distinct pane as s from pts), win as (select s, id, label from samples join pts on pane > s-{PANES} and pane <= s),
 cells as (select s, coalesce(h.cluster, -1) as cluster, w.label, count(*)::double as n from win w left join held h using (id) group by 1, 2, 3),
 full_ as (select *, sum(n) over (partition by s, cluster) as r, sum(n) over (partition by s, label) as k, sum(n) over (partition by s) as a from cells)"""
_ENTROPY = """classes as (select s, count(distinct label) as c from cells group by 1), e0 as (select s, -sum(n/a*log10(n/r))/log10(6) as hc, -sum(n/a*log10(n/k))/log10(max(c)) as hk, -sum(n/a*log10(r/a))/log10(6) as er, -sum(n/a*log10(k/a))/log10(max(c)) as ek, sum(n/a*log10(n/r/k*a))/log10(max(c)) as mi from full_ join classes using (s) group by 1),
 e as (select *, case when er = 0 then 1 else 1-hc/er end as hom, case when ek = 0 then 1 else 1-hk/ek end as com from e0)"""
_F1 = """f as (select *, n/r as p, 2*(n/r)*(n/k)/(n/r+n/k) as f1 from full_), fb as (select s, cluster, arg_max(p, (n, -label)) as p, arg_max(f1, (n, -label)) as f1 from f where cluster <> -1 group by 1, 2), fc1 as (select s, label, coalesce(max(f1) filter (cluster <> -1), 0) as best from f group by 1, 2)"""
_PAIRS = """hs as (select s, h.id, h.cluster from held h join win using (id)), seen_ as (select distinct id from held), vecs as (select id, list(v order by i) as x from tall semi join seen_ using (id) group by id), near_ as (select a.id, b.id as id2, list_distance(a.x, b.x) as d from vecs a join vecs b on a.id <> b.id),
 m as (select w.s, p.id, h.cluster, avg(d) as d from near_ p join hs h on h.id = p.id2 join (select distinct s, id from hs) w on w.id = p.id and w.s = h.s group by 1, 2, 3), own as (select m.s, m.id, arg_min(m.cluster, (d, m.cluster)) as cluster, min(d) as a from m join hs using (s, id, cluster) group by 1, 2),
 sil as (select own.s, own.id, a, min(m.d) as b from own join m on m.s = own.s and m.id = own.id and m.cluster <> own.cluster group by 1, 2, 3), ci as (select h.s, avg(d) as mean, min(d) as low, max(d) as high from near_ p join hs h on h.id = p.id join hs g on g.s = h.s and g.cluster = h.cluster and g.id = p.id2 where p.id < p.id2 group by 1)"""
_VALUES = [
    ("ssq", "select s, sum(d) as v from (select s, id, min(d2) as d from win join dist using (id) group by 1, 2) group by 1"),
    ("precision", "select s, 1.0 as v from samples"),
    ("recall", "select s, count(*) filter (h > 0)/count(*) as v from hits group by 1"),
    ("redundancy", "select s, count(*) filter (h > 1)/count(*) as v from hits group by 1"),
    ("van_dongen", "select s, (b1+b2)/(2*a) as v from (select s, sum(m) as b1, sum(r) as a from (select s, cluster, max(n) as m, sum(n) as r from cells group by 1, 2) group by 1) join (select s, sum(m) as b2 from (select s, label, max(n) as m from cells group by 1, 2) group by 1) using (s)"),
    ("rand", "select s, (a*(a-1)/2-m1-m2+2*m)/(a*(a-1)/2) as v from (select s, sum(r*(r-1)/2) as m1, sum(r) as a from (select s, cluster, sum(n) as r from cells group by 1, 2) group by 1) join (select s, sum(k*(k-1)/2) as m2 from (select s, label, sum(n) as k from cells group by 1, 2) group by 1) using (s) join (select s, sum(n*(n-1)/2) as m from cells group by 1) using (s)"),
    ("fc_cross_entropy", "select s, 1-hc as v from e"), ("gt_cross_entropy", "select s, 1-hk as v from e"), ("homogeneity", "select s, case when hom > 1 or hom < 0 then -1 else hom end as v from e"), ("completeness", "select s, com as v from e"),
    ("v_measure", "select s, case when hom < 0 or 2*hom*com/(hom+com) > 1 then -1 when hom+com <> 0 then 2*hom*com/(hom+com) else 0 end as v from e"), ("var_information", "select s, case when er+ek > 0 then 2*mi/(er+ek) else 1 end as v from e"),
    ("f1_p", "select s, avg(f1) as v from fb group by 1"), ("purity", "select s, avg(p) as v from fb group by 1"), ("f1_r", "select s, avg(best) as v from fc1 group by 1"),
    ("silhouette", "select s, (avg((b-a)/greatest(a, b))+1)/2 as v from sil group by 1"), ("c_index", "select s, case when high > low then (mean-low)/(high-low) else 0 end as v from ci"),
]
_TOLD = " union all ".join(f"select samples.s, '{name}' as measure, v from samples left join ({sql}) x on x.s = samples.s" for name, sql in _VALUES)
SQL = {"horizon_measures": f"with {FOUND}, {_WINDOW}, hits as (select s, win.id, count(held.id) as h from win left join held using (id) group by 1, 2), {_ENTROPY}, {_F1}, {_PAIRS} select s::int as sample, measure, round(v, 5)+0.0 as value from ({_TOLD})"}
