"""Queries for Hoeffding trees, generated streams, dataflow and scalar helpers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import flows, tasks
from tidemark.functions import scalars as X
from tidemark.operators import hoeffding as H
from tidemark.operators import rules as R
from tidemark.operators import statistics as S
from tidemark.sources import generators as G

from .streams import ATTRIBUTES, CLASSES, CUMULATIVE, LONG, MAJORITY, MEASURES, R6, _metrics_sql, events, items, normal_cdf_sql, read, rounded


def vht_batches(spark, d):
    rows = events(spark, d).withColumn("batch", F.floor(F.col("idx") / 200).cast("long"))
    return rows.groupBy("batch", "y").agg(F.count("*").alias("n"))


def _root_cells(spark, d):
    cuts = S.gaussian_cuts(S.gaussian_observers(items(spark, d), ATTRIBUTES, "l_returnflag"), "l_returnflag")
    branches = F.explode(F.array(F.struct(F.lit("0").alias("branch"), F.col("below").alias("weight")), F.struct(F.lit("1").alias("branch"), F.col("above").alias("weight"))))
    return cuts.select("attribute", "k", F.col("l_returnflag").alias("y"), branches.alias("b")).select("attribute", "k", "y", "b.branch", "b.weight")


def vht_root_merits(spark, d):
    return rounded(S.info_gain(_root_cells(spark, d), ["attribute", "k"], "y"), 6, "merit")


def vht_root_split(spark, d):
    best = S.info_gain(_root_cells(spark, d), ["attribute", "k"], "y").groupBy("attribute").agg(F.max("merit").alias("merit"))
    n = read(spark, d, "lineitem").count()
    return rounded(S.hoeffding_decision(best, F.lit(float(n)), F.log2(F.lit(3.0)), 1e-7, 0.05), 6, "best", "second", "epsilon")


def vht_branches(spark, d):
    rows = read(spark, d, "lineitem").select("l_quantity", "l_linenumber")
    return rows.select(R.binary_branch(F.col("l_quantity"), 25.0).alias("numeric"), R.nominal_branch(F.col("l_linenumber"), 3).alias("nominal")).groupBy("numeric", "nominal").agg(F.count("*").alias("n"))


def _orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.year("o_orderdate").cast("double").alias("year"), F.dayofyear("o_orderdate").cast("double").alias("day"))


def vht_predict(spark, d):
    rows = _orders(spark, d)
    tree = H.HoeffdingTree(sorted(r[0] for r in rows.select("o_orderstatus").distinct().collect()), ["o_totalprice", "year", "day"], ["o_orderpriority"])
    out = H.prequential(rows, tree, "o_orderkey", "o_orderstatus", 4)
    return out.groupBy("o_orderstatus", "pred").agg(F.count("*").alias("n"))


def prequential_task(spark, d):
    rows = read(spark, d, "events").select("event_id", "event_type")
    return rounded(tasks.prequential(rows, "event_id", "event_type", CLASSES, every=1000), 6, "accuracy", "kappa", "kappa_temporal")


def clustering_task(spark, d):
    from .clusters import points

    return rounded(tasks.clustering_evaluation(points(spark, d), "id", kernels=50, horizon=500), 4, "ssq", "van_dongen", "rand")


def _size(spark, d):
    return read(spark, d, "events").count()


def stream_hyperplane(spark, d):
    rows = G.hyperplane(spark, _size(spark, d), attributes=4)
    return rounded(rows.groupBy("class").agg(F.count("*").alias("n"), F.avg("att1").alias("mean")), 6, "mean")


def stream_hyperplane_drift(spark, d):
    rows = G.hyperplane(spark, _size(spark, d), attributes=4, change=0.001)
    return rows.groupBy("class").agg(F.count("*").alias("n"))


def stream_random_tree(spark, d):
    return G.random_tree(spark, _size(spark, d)).groupBy("nominal1", "class").agg(F.count("*").alias("n"))


def stream_rbf(spark, d):
    rows = G.RandomRBF(events=True, every=300).rows(spark, _size(spark, d))
    return rounded(rows.groupBy("class").agg(F.count("*").alias("n"), F.avg("att1").alias("mean")), 6, "mean")


def stream_rbf_truth(spark, d):
    out = G.RandomRBF(events=True, every=300).truth(spark, _size(spark, d))
    return out.select("idx", "cluster", F.round(F.col("centre")[0], 6).alias("x"), "radius")


def stream_rbf_changes(spark, d):
    return G.RandomRBF(events=True, every=300).changes(spark, _size(spark, d))


def corr_helper(spark, d):
    rows = read(spark, d, "lineitem")
    return rounded(rows.groupBy("l_returnflag").agg(F.coalesce(F.nanvl(F.corr("l_quantity", "l_extendedprice"), F.lit(1.0)), F.lit(1.0)).alias("corr"), F.coalesce(F.var_samp("l_tax"), F.lit(0.0)).alias("variance")), 6, "corr", "variance")


def _by_user(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.array(*(F.count(F.when(F.col("y") == c, 1)).cast("double") for c in range(5))).alias("w"))


def array_helpers(spark, d):
    w = F.col("w")
    rows = _by_user(spark, d).select("user_id", X.max_index(w).alias("most"), X.min_index(w).alias("least"), X.kth_smallest(w, 2).alias("second"), X.entropy(w).alias("bits"), F.get(X.normalize(w), 0).alias("share"), F.get(X.logs2probs(w), 1).alias("prob"))
    return rounded(rows, 6, "bits", "share", "prob")


def scalar_helpers(spark, d):
    v = F.col("value")
    rows = events(spark, d).select("idx", X.xlogx(v).alias("xlogx"), X.log_odds(F.col("y") / 4).alias("odds"), X.normal_cdf((v - 50) / 25).alias("phi"), X.decayed(0.01, F.lit(100), F.col("idx") % 100).alias("decay"), X.about_equal(v, F.round(v, 0)).alias("whole"), X.greater(v, F.lit(50.0)).alias("above"))
    return rounded(rows, 5, "xlogx", "odds", "phi", "decay")


def text_helpers(spark, d):
    e = F.col("event_type")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.lpad(e, 10, " ").alias("padded"), F.concat(F.lit("'"), F.replace(e, F.lit("'"), F.lit("\\'")), F.lit("'")).alias("quoted"), F.replace(e, F.lit("e"), F.lit("")).alias("less"), F.format_string("%s <= %d", e, F.col("n")).alias("text"))


def weighted_pick(spark, d):
    """One of a user's event types at random, by their counts."""
    rows = _by_user(spark, d).withColumn("u", X.hash_uniform(F.col("user_id").cast("string"), F.lit("pick")) * X.total(F.col("w")))
    sums = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: X.total(F.slice("w", 1, k)))
    return rows.select("user_id", F.size(F.filter(sums, lambda s: s <= F.col("u"))).alias("picked"))


def partition_by_key(spark, d):
    """Rows of a key stay together: every user is in one of the partitions."""
    dealt = flows.dealt(events(spark, d), flows.KEY, 4, "user_id").select("user_id", F.spark_partition_id().alias("p"))
    return dealt.groupBy("user_id").agg(F.countDistinct("p").cast("int").alias("partitions"), F.count("*").alias("n"))


def broadcast_copies(spark, d):
    """Every row to each of three copies of an operator."""
    return flows.dealt(events(spark, d), flows.ALL, 3).groupBy("copy").agg(F.count("*").alias("n"))


def union_inputs(spark, d):
    rows = events(spark, d)
    return rows.where("y = 1").select("idx", F.lit("error").alias("input")).unionByName(rows.where("value > 50").select("idx", F.lit("high").alias("input"))).groupBy("input").agg(F.count("*").alias("n"))


def sampled_evaluation(spark, d):
    """Points drawn for evaluation with probability one half, the same in every run."""
    rows = events(spark, d).where(X.hash_uniform(F.col("idx").cast("string"), F.lit("s")) < 0.5)
    return rows.groupBy("y").agg(F.count("*").alias("n"))


QUERIES = {
    "vht_batches": vht_batches, "vht_root_merits": vht_root_merits, "vht_root_split": vht_root_split, "vht_branches": vht_branches, "vht_predict": vht_predict, "prequential_task": prequential_task, "clustering_task": clustering_task,
    "stream_hyperplane": stream_hyperplane, "stream_hyperplane_drift": stream_hyperplane_drift, "stream_random_tree": stream_random_tree, "stream_rbf": stream_rbf, "stream_rbf_truth": stream_rbf_truth, "stream_rbf_changes": stream_rbf_changes,
    "corr_helper": corr_helper, "array_helpers": array_helpers, "scalar_helpers": scalar_helpers, "text_helpers": text_helpers, "weighted_pick": weighted_pick, "partition_by_key": partition_by_key, "broadcast_copies": broadcast_copies,
    "union_inputs": union_inputs, "sampled_evaluation": sampled_evaluation,
}

_ROOT = f"rowed as (select 1 as r, * from lineitem), tall as ({LONG}), st as (select a, c, count(*)::double as n, avg(x) as m, greatest(coalesce(var_samp(x),0),0) as v, min(x) as lo, max(x) as hi from tall group by 1,2), sp as (select a, min(lo) as f, max(hi) as t from st group by 1), ks as (select a, k, f+(t-f)*k/11.0 as cut from sp, range(1,11) r(k)), b as (select a, k, c, n, case when cut < lo then 0.0 when cut >= hi then n else n*(case when v > 0 then {normal_cdf_sql('((cut-m)/sqrt(v))')} else (cut >= m)::int end) end as below from st join ks using (a)), cells as (select a, k, c, 0 as br, below as w from b union all select a, k, c, 1, n-below from b), good as (select * from cells where w > 0), br as (select a, k, br, sum(w) as w, log2(sum(w)) - sum(w*log2(w))/sum(w) as bits from good group by 1,2,3), post as (select a, k, sum(w) as w, sum(w*bits)/sum(w) as after, min(w) as low, count(*) as nb from br group by 1,2), pre0 as (select a, k, c, sum(w) as w from good group by 1,2,3), pre as (select a, k, log2(sum(w)) - sum(w*log2(w))/sum(w) as bits from pre0 group by 1,2), gain as (select a, k, case when nb = 2 and low > 0.01*w then bits-after end as merit from post join pre using (a, k))"
_MD5 = lambda *keys: f"(('0x'||substr(md5({'||chr(124)||'.join(keys)}),1,8))::BIGINT/4294967296.0)"
Q1 = "'1'"
_W = "w as (select user_id, " + ", ".join(f"count(*) filter (event_type='{c}')::double as w{k}" for k, c in enumerate(CLASSES)) + " from events group by 1), l as (select *, [w0,w1,w2,w3,w4] as w, w0+w1+w2+w3+w4 as t from w)"
_ATT = ", ".join(_MD5("'1'", "idx::varchar", f"'x{k}'") + f" as a{k}" for k in range(4))
_HW = [_MD5("'1'", "'w'", f"'{k}'") for k in range(4)]
_Y = f"(list_position({CLASSES!r}, event_type)-1)"
SQL = {
    "vht_batches": f"select event_id // 200 as batch, {_Y} as y, count(*) as n from events group by all",
    "vht_root_merits": f"with {_ROOT} select a as attribute, k::int as k, round(merit,6)+0.0 as merit from gain",
    "vht_root_split": f"with {_ROOT}, m as (select a, max(merit) as merit from gain group by 1), t as (select list(merit order by merit desc) filter (merit is not null) as m from m), e as (select coalesce(m[1],0) as best, greatest(coalesce(m[2],0),0) as second, sqrt(log2(3.0)*log2(3.0)*ln(1e7)/(2*(select count(*) from lineitem))) as epsilon from t) select round(best,6)+0.0 as best, round(second,6)+0.0 as second, round(epsilon,6) as epsilon, best > 0 and (best-second > epsilon or epsilon < 0.05) as split from e",
    "vht_branches": "select case when l_quantity is null then -1 when l_quantity <= 25 then 0 else 1 end as numeric, case when l_linenumber is null then -1 when l_linenumber = 3 then 0 else 1 end as nominal, count(*) as n from lineitem group by all",
    "stream_hyperplane": f"with i as (select range as idx from range((select count(*) from events))), a as (select idx, {_ATT}, {_MD5(chr(39) + '1' + chr(39), 'idx::varchar', chr(39) + 'noise' + chr(39))} as u from i), c as (select *, (({'+'.join(f'{w}*a{k}' for k, w in enumerate(_HW))}) >= 0.5*({'+'.join(_HW)})) <> (u < 0.05) as on_ from a) select case when on_ then 'class2' else 'class1' end as class, count(*) as n, round(avg(a0),6) as mean from c group by 1",
    "corr_helper": "select l_returnflag, round(coalesce(corr(l_quantity,l_extendedprice),1),6) as corr, round(coalesce(var_samp(l_tax),0),6) as variance from lineitem group by 1",
    "array_helpers": f"with {_W} select user_id, (list_position(w, list_max(w))-1)::int as most, (list_position(w, list_min(w))-1)::int as least, list_sort(w)[2] as second, round(log2(t) - list_sum([case when x > 0 then x*log2(x) else 0 end for x in w])/t,6)+0.0 as bits, round(w0/t,6)+0.0 as share, round(exp(w1-list_max(w))/list_sum([exp(x-list_max(w)) for x in w]),6)+0.0 as prob from l",
    "scalar_helpers": f"with e as (select event_id as idx, {_Y}/4.0 as p, value from events) select idx, round(case when value > 0 then value*log2(value) else 0 end,5)+0.0 as xlogx, round(ln(greatest(least(p,1-1e-6::double),1e-6::double)/(1-greatest(least(p,1-1e-6::double),1e-6::double))),5)+0.0 as odds, round({normal_cdf_sql('((value-50)/25)')},5)+0.0 as phi, round(power(2.0,-0.01*(100-idx%100)),5) as decay, abs(value-round(value,0)) < 1e-6 as whole, value-50 > 1e-6 as above from e",
    "text_helpers": "select lpad(event_type,10,' ') as padded, chr(39)||event_type||chr(39) as quoted, replace(event_type,'e','') as less, event_type||' <= '||count(*) as text from events group by event_type",
    "weighted_pick": f"with {_W}, u as (select *, {_MD5('user_id::varchar', chr(39) + 'pick' + chr(39))}*t as u from l) select user_id, ((w0 <= u)::int + (w0+w1 <= u)::int + (w0+w1+w2 <= u)::int + (w0+w1+w2+w3 <= u)::int + (t <= u)::int) as picked from u",
    "partition_by_key": "select user_id, 1::int as partitions, count(*) as n from events group by 1",
    "broadcast_copies": "select copy::int as copy, count(*) as n from events, range(3) r(copy) group by 1",
    "union_inputs": "select 'error' as input, count(*) as n from events where event_type='error' union all select 'high', count(*) from events where value > 50",
    "sampled_evaluation": f"select {_Y} as y, count(*) as n from events where {_MD5('event_id::varchar', chr(39) + 's' + chr(39))} < 0.5 group by 1",
}
_TURN = ", ".join(f"sum(({_MD5(Q1, 'idx::varchar', f'{chr(39)}t{k}{chr(39)}')} < 0.1)::int) over (order by idx) as t{k}" for k in range(2))
_MOVE = ", ".join(f"coalesce(sum(case when t{k} % 2 = 0 then 0.001::double else -0.001::double end) over (order by idx rows between unbounded preceding and 1 preceding), 0) as m{k}" for k in range(2))
_DW = [f"({w}+m{k})" if k < 2 else w for k, w in enumerate(_HW)]
SQL["stream_hyperplane_drift"] = f"with i as (select range as idx from range((select count(*) from events))), a as (select idx, {_ATT}, {_MD5(Q1, 'idx::varchar', chr(39) + 'noise' + chr(39))} as u, {_TURN} from i), b as (select *, {_MOVE} from a), c as (select *, (({'+'.join(f'{w}*a{k}' for k, w in enumerate(_DW))}) >= 0.5*({'+'.join(_DW)})) <> (u < 0.05) as on_ from b) select case when on_ then 'class2' else 'class1' end as class, count(*) as n from c group by 1"
SQL["prequential_task"] = f"with {MAJORITY}{_metrics_sql(CUMULATIVE)} select n, {R6(*MEASURES)} from metrics where n % 1000 = 0 or n = (select max(n) from metrics)"
