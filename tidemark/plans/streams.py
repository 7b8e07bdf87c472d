"""Queries on the driver's tables: evaluation, statistics and splits; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_cdf_sql
from tidemark.operators import evaluation as E
from tidemark.operators import statistics as S
from tidemark.operators.ordered import in_blocks, numbered

CLASSES = ["click", "error", "purchase", "signup", "view"]
ATTRIBUTES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """The stream as instances: idx, user_id, y (class index), value."""
    y = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("event_type")) - 1
    return read(spark, d, "events").select(F.col("event_id").alias("idx"), "user_id", y.cast("int").alias("y"), "value")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounds the columns; adding 0.0 turns a negative zero positive."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


EVENTS = f"events_i as (select event_id as idx, user_id, list_position({CLASSES!r}, event_type)-1 as y, value from events)"
MAJORITY = (
    EVENTS + ", seen as (select *, " + ", ".join(f"coalesce(sum((y={c})::int) over (order by idx rows between unbounded preceding and 1 preceding),0) as s{c}" for c in range(5)) + " from events_i), "
    "predicted as (select idx, user_id, y, value, case " + " ".join(f"when s{c}=greatest(s0,s1,s2,s3,s4) then {c}" for c in range(5)) + " end as pred, coalesce(lag(y) over (order by idx),0) as prev from seen)"
)


def _metrics_sql(frame: str) -> str:
    sums = ", ".join(f"sum((y={c})::int) over w as t{c}, sum((pred={c})::int) over w as p{c}" for c in range(5))
    pc = " + ".join(f"t{c}*p{c}/(w*w)" for c in range(5))
    return (
        f", sums as (select idx, count(*) over w ::double as w, count(*) over (order by idx rows between unbounded preceding and current row) as n, sum((y=pred)::int) over w as hit, sum((y=prev)::int) over w as same, {sums} from predicted window w as (order by idx {frame})), "
        f"metrics as (select idx, n, 100*hit/w as accuracy, case when ({pc}) < 1 then 100*(hit/w-({pc}))/(1-({pc})) end as kappa, case when same/w < 1 then 100*(hit/w-same/w)/(1-same/w) end as kappa_temporal from sums)"
    )


CUMULATIVE, WINDOW = "rows between unbounded preceding and current row", "rows between 999 preceding and current row"
MEASURES = ["accuracy", "kappa", "kappa_temporal"]
R6 = lambda *names: ", ".join(f"round({n},6)+0.0 as {n}" for n in names)


def predicted(spark, d):
    return E.majority(in_blocks(events(spark, d), "idx"), "idx", "y", 5)


def prequential_majority(spark, d):
    return rounded(E.classification_total(predicted(spark, d), "idx", "y", "pred", 5), 6, *MEASURES)


def classification_cumulative(spark, d):
    curve = E.classification(predicted(spark, d), "idx", "y", "pred", 5)
    return rounded(curve.select("idx", *MEASURES), 6, *MEASURES)


def classification_window(spark, d):
    curve = E.classification(predicted(spark, d), "idx", "y", "pred", 5, width=1000)
    return rounded(curve.select("idx", *MEASURES), 6, *MEASURES)


def learning_curve(spark, d):
    curve = numbered(E.classification(predicted(spark, d), "idx", "y", "pred", 5), "idx").withColumn("n", F.col("rn") + 1)
    return rounded(E.sampled(curve.select("n", *MEASURES), F.col("n"), 1000), 6, *MEASURES)


def learning_curve_rows(spark, d):
    return E.curve_rows(learning_curve(spark, d), "n", MEASURES)


def curve_summary(spark, d):
    rows = E.curve_rows(learning_curve(spark, d), "n", MEASURES)
    out = ["least", "most", "mean", "std_error", "lower", "median", "upper"]
    return rounded(E.measure_summary(rows, "name", "value"), 5, *out)


def regression_prequential(spark, d):
    rows = E.running_mean(in_blocks(events(spark, d), "idx"), "idx", "value")
    out = E.regression(rows, "idx", "value", "pred")
    names = ["mae", "rmse", "relative_mae", "relative_rmse"]
    return rounded(out.select("idx", *names), 5, *names)


def items(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", *ATTRIBUTES)


def gaussian_observer_stats(spark, d):
    return rounded(S.gaussian_observers(items(spark, d), ATTRIBUTES, "l_returnflag"), 4, "mean", "variance")


def nominal_contingency(spark, d):
    return S.nominal_counts(read(spark, d, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag")


def nb_class_prior(spark, d):
    return rounded(S.class_priors(items(spark, d), "l_returnflag"), 6, "prior")


def nb_predicted(spark, d):
    rows = items(spark, d)
    return S.NaiveBayes(ATTRIBUTES).fit(rows, "l_returnflag").predict(rows)


def nb_predict(spark, d):
    return nb_predicted(spark, d).groupBy("pred").agg(F.count("*").alias("n"))


def nb_confusion(spark, d):
    return S.confusion(nb_predicted(spark, d), "l_returnflag", "pred")


def nb_kappa(spark, d):
    return rounded(S.kappa(S.confusion(nb_predicted(spark, d), "l_returnflag", "pred")), 6, "accuracy", "kappa")


PDF = "case when s.v > 0 then exp(-0.5*power((x-s.m)/sqrt(s.v),2))/(sqrt(2*pi())*sqrt(s.v)) else (x=s.m)::int end"
LONG = " union all ".join(f"select r, l_returnflag as c, '{a}' as a, {a}::double as x from rowed" for a in ATTRIBUTES)
NB = f"""rowed as (select row_number() over () as r, * from lineitem), tall as ({LONG}),
 stats as (select a, c, avg(x) as m, greatest(coalesce(var_samp(x),0),0) as v from tall group by a, c),
 prior as (select l_returnflag as c, count(*)/(select count(*) from lineitem) as p from lineitem group by 1),
 proto as (select c, ln(1+sum({PDF.replace("(x", "(0.0").replace("x=", "0.0=")})) as q from stats s group by c),
 votes as (select t.r, t.c as y, s.c, sum(ln({PDF})) as v from tall t join stats s on s.a=t.a group by 1,2,3),
 picked as (select r, y, arg_max(votes.c, (v+ln(p)+q)) as pred from votes join prior on prior.c=votes.c join proto on proto.c=votes.c group by r, y)"""



def _cells(spark, d, attributes=("l_linestatus", "l_linenumber")):
    return S.nominal_counts(read(spark, d, "lineitem"), list(attributes), "l_returnflag").select("attribute", F.col("value").alias("branch"), F.col("l_returnflag").alias("y"), F.col("n").cast("double").alias("weight"))


CELLS = "cells as (" + " union all ".join(f"select '{a}' as attribute, {a}::varchar as branch, l_returnflag as y, count(*)::double as weight from lineitem group by 2,3" for a in ("l_linestatus", "l_linenumber")) + ")"
GAIN = CELLS + """, branch as (select attribute, branch, sum(weight) as w, -sum(weight*log2(weight)) as x from cells group by 1,2),
 post as (select attribute, sum(w) as w, sum(x + w*log2(w)) as after, count(*) filter (w > 0.01*(select sum(weight) from cells c where c.attribute=b.attribute)) as big from branch b group by 1),
 pre as (select attribute, sum(weight) as w, y from cells group by 1,3), before as (select attribute, log2(sum(w)) - sum(w*log2(w))/sum(w) as bits from pre group by 1),
 gain as (select post.attribute, case when big >= 2 then bits - after/post.w end as merit from post join before using (attribute))"""


def infogain_nominal(spark, d):
    return rounded(S.info_gain(_cells(spark, d), ["attribute"], "y"), 6, "merit")


def gini_nominal(spark, d):
    return rounded(S.gini(_cells(spark, d), ["attribute"]), 6, "merit")


def infogain_multilabel(spark, d):
    return rounded(S.info_gain_multilabel(_cells(spark, d), ["attribute", "branch"]), 6, "bits")


def hoeffding_decision(spark, d):
    merits = S.info_gain(_cells(spark, d), ["attribute"], "y")
    n = read(spark, d, "lineitem").count()
    return rounded(S.hoeffding_decision(merits, F.lit(float(n)), F.log2(F.lit(3.0)), 1e-7, 0.05), 6, "best", "second", "epsilon")


def exact_numeric_split(spark, d):
    cuts = S.numeric_cuts(items(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_returnflag", ["A", "N", "R"])
    best = S.best_by(S.cut_info_gain(cuts, 3).withColumn("merit", F.round("merit", 9)), "attribute", "merit", ["value"])
    return best.select("attribute", "value", "merit")


CUTS = ", ".join(f"sum(sum((l_returnflag='{c}')::int)) over (partition by a order by x)::double as l{k}, sum(sum((l_returnflag='{c}')::int)) over (partition by a)::double as t{k}" for k, c in enumerate("ANR"))
BITS = lambda p: f"(case when {'+'.join(p)} > 0 then log2({'+'.join(p)}) - (" + "+".join(f"case when {x} > 0 then {x}*log2({x}) else 0 end" for x in p) + f")/({'+'.join(p)}) else 0 end)"
EXACT = "tall as (" + " union all ".join(f"select l_returnflag, '{a}' as a, {a}::double as x from lineitem" for a in ("l_quantity", "l_discount", "l_tax")) + f"), cuts as (select a, x, {CUTS} from tall group by a, x), merits as (select a, x, case when wl > 0.01*w and w-wl > 0.01*w then round({BITS(['t0', 't1', 't2'])} - (wl*{BITS(['l0', 'l1', 'l2'])} + (w-wl)*{BITS(['(t0-l0)', '(t1-l1)', '(t2-l2)'])})/w, 9) end as merit from (select *, l0+l1+l2 as wl, t0+t1+t2 as w from cuts))"


def _regression(spark, d, **how):
    rows = read(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount")
    cuts = S.variance_reduction(S.regression_cuts(rows, ["l_quantity", "l_discount"], "l_extendedprice"), **how)
    return rounded(cuts.select("attribute", "value", "merit"), 2, "merit")


def _regression_sql(root: bool, least: float, share: float) -> str:
    f = "sqrt" if root else ""
    sd = lambda n, s, q: f"{f}(greatest(({q}-({s})*({s})/({n}))/({n}),0))"
    return f"""with tall as (select l_extendedprice::double as y, 'l_quantity' as a, l_quantity::double as x from lineitem union all select l_extendedprice::double, 'l_discount', l_discount::double from lineitem),
 cuts as (select a, x, sum(count(*)) over o::double as ln, sum(sum(y)) over o as ls, sum(sum(y*y)) over o as lq, sum(count(*)) over p::double as n, sum(sum(y)) over p as s, sum(sum(y*y)) over p as q from tall group by a, x window o as (partition by a order by x), p as (partition by a))
 select a as attribute, x as value, case when ln >= {least} and n-ln >= {least} and ln >= {share}*n and n-ln >= {share}*n then round({sd("n", "s", "q")} - ln/n*{sd("ln", "ls", "lq")} - (n-ln)/n*{sd("(n-ln)", "(s-ls)", "(q-lq)")}, 2)+0.0 end as merit from cuts"""


def gaussian_split_candidates(spark, d):
    cuts = S.gaussian_cuts(S.gaussian_observers(items(spark, d), ATTRIBUTES, "l_returnflag"), "l_returnflag")
    return rounded(cuts, 3, "cut", "below", "above")


QUERIES = {
    "prequential_majority": prequential_majority, "classification_metrics_cumulative": classification_cumulative, "classification_metrics_window1000": classification_window,
    "learning_curve_sampled": learning_curve, "learning_curve_rows": learning_curve_rows, "measure_summary": curve_summary, "regression_metrics_prequential": regression_prequential,
    "gaussian_observer_stats": gaussian_observer_stats, "nominal_contingency": nominal_contingency, "nb_class_prior": nb_class_prior, "nb_predict": nb_predict, "nb_confusion": nb_confusion, "nb_kappa": nb_kappa,
    "infogain_nominal": infogain_nominal, "gini_nominal": gini_nominal, "infogain_multilabel": infogain_multilabel, "hoeffding_decision": hoeffding_decision, "exact_numeric_split": exact_numeric_split,
    "variance_reduction": lambda s, d: _regression(s, d), "sdr_reduction": lambda s, d: _regression(s, d, root=True), "sdr_amrules": lambda s, d: _regression(s, d, root=True, least=0, share=0.05),
    "gaussian_split_candidates": gaussian_split_candidates,
}

_CURVE = f"with {MAJORITY}{_metrics_sql(CUMULATIVE)}, curve as (select n, {R6(*MEASURES)} from metrics where n % 1000 = 0)"
_CURVE_ROWS = _CURVE + ", tall as (" + " union all ".join(f"select n, '{m}' as name, {m} as value from curve where {m} is not null" for m in MEASURES) + ")"
SQL = {
    "prequential_majority": f"with {MAJORITY}{_metrics_sql(CUMULATIVE)} select n as instances, {R6(*MEASURES)} from metrics order by idx desc limit 1",
    "classification_metrics_cumulative": f"with {MAJORITY}{_metrics_sql(CUMULATIVE)} select idx, {R6(*MEASURES)} from metrics",
    "classification_metrics_window1000": f"with {MAJORITY}{_metrics_sql(WINDOW)} select idx, {R6(*MEASURES)} from metrics",
    "learning_curve_sampled": _CURVE + " select * from curve",
    "learning_curve_rows": _CURVE_ROWS + " select * from tall",
    "measure_summary": _CURVE_ROWS + " select name, count(value) as n, round(min(value),5) as least, round(max(value),5) as most, round(avg(value),5) as mean, round(stddev_samp(value)/sqrt(count(value)),5) as std_error, round(quantile_cont(value,0.25),5) as lower, round(quantile_cont(value,0.5),5) as median, round(quantile_cont(value,0.75),5) as upper from tall group by name",
    "regression_metrics_prequential": "with p as (select event_id as idx, value, coalesce(avg(value) over (order by event_id rows between unbounded preceding and 1 preceding),0) as base, coalesce(avg(value) over (order by event_id rows between 10 preceding and 1 preceding),0) as pred from events), s as (select idx, count(*) over w as n, sum(abs(pred-value)) over w as e1, sum((pred-value)*(pred-value)) over w as e2, sum(abs(base-value)) over w as b1, sum((base-value)*(base-value)) over w as b2 from p window w as (order by idx rows between unbounded preceding and current row)) select idx, round(e1/n,5)+0.0 as mae, round(sqrt(e2/n),5)+0.0 as rmse, round(e1/nullif(b1,0),5)+0.0 as relative_mae, round(sqrt(e2/nullif(b2,0)),5)+0.0 as relative_rmse from s",
    "gaussian_observer_stats": f"with rowed as (select 1 as r, * from lineitem), tall as ({LONG}) select a as attribute, c as l_returnflag, count(*) as n, round(avg(x),4) as mean, round(var_samp(x),4) as variance, min(x) as low, max(x) as high from tall group by a, c",
    "nominal_contingency": "select 'l_linestatus' as attribute, l_linestatus as value, l_returnflag, count(*) as n from lineitem group by all union all select 'l_linenumber', l_linenumber::varchar, l_returnflag, count(*) from lineitem group by all",
    "nb_class_prior": "select l_returnflag, count(*) as n, round(count(*)/(select count(*) from lineitem),6) as prior from lineitem group by 1",
    "nb_predict": f"with {NB} select pred, count(*) as n from picked group by 1",
    "nb_confusion": f"with {NB} select y as actual, pred as predicted, count(*) as n from picked group by 1,2",
    "nb_kappa": f"with {NB}, cells as (select y, pred, count(*) as n from picked group by 1,2), t as (select sum(n)::double as n, sum(n) filter (y=pred) as hits from cells), ch as (select sum(r.n*p.n)::double as chance from (select y as c, sum(n) as n from cells group by 1) r join (select pred as c, sum(n) as n from cells group by 1) p using (c)) select n::bigint as n, round(hits/n,6) as accuracy, round((hits/n-chance/(n*n))/(1-chance/(n*n)),6) as kappa from t, ch",
    "infogain_nominal": f"with {GAIN} select attribute, round(merit,6)+0.0 as merit from gain",
    "gini_nominal": f"with {CELLS}, b as (select attribute, branch, sum(weight) as w, 1-sum(weight*weight)/(sum(weight)*sum(weight)) as g from cells group by 1,2) select attribute, round(1-sum(w*g)/sum(w),6) as merit from b group by 1",
    "infogain_multilabel": f"with {CELLS}, t as (select *, weight/sum(weight) over (partition by attribute, branch) as p from cells) select attribute, branch, round(-sum(p*log2(p) + case when p < 1 then (1-p)*log2(1-p) else 0 end),6)+0.0 as bits from t group by 1,2",
    "hoeffding_decision": f"with {GAIN}, t as (select list(merit order by merit desc) filter (merit is not null) as m from gain), e as (select coalesce(m[1],0) as best, greatest(coalesce(m[2],0),0) as second, sqrt(log2(3.0)*log2(3.0)*ln(1e7)/(2*(select count(*) from lineitem))) as epsilon from t) select round(best,6) as best, round(second,6)+0.0 as second, round(epsilon,6) as epsilon, best > 0 and (best-second > epsilon or epsilon < 0.05) as split from e",
    "exact_numeric_split": f"with {EXACT} select a as attribute, x as value, merit from merits qualify row_number() over (partition by a order by merit desc nulls last, x) = 1",
    "variance_reduction": _regression_sql(False, 5, 0), "sdr_reduction": _regression_sql(True, 5, 0), "sdr_amrules": _regression_sql(True, 0, 0.05),
    "gaussian_split_candidates": f"with rowed as (select 1 as r, * from lineitem), tall as ({LONG}), st as (select a, c, count(*)::double as n, avg(x) as m, greatest(coalesce(var_samp(x),0),0) as v, min(x) as lo, max(x) as hi from tall group by 1,2), sp as (select a, min(lo) as f, max(hi) as t from st group by 1), ks as (select a, k, f+(t-f)*k/11.0 as cut from sp, range(1,11) r(k)), b as (select a, k, cut, c, n, case when cut < lo then 0.0 when cut >= hi then n else n*(case when v > 0 then {normal_cdf_sql('((cut-m)/sqrt(v))')} else (cut >= m)::int end) end as below from st join ks using (a)) select a as attribute, k::int as k, round(cut,3)+0.0 as cut, c as l_returnflag, round(below,3)+0.0 as below, round(n-below,3)+0.0 as above from b",
}
