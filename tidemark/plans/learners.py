"""Queries for ensembles and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_uniform, poisson1, poisson1_sql
from tidemark.operators import drift as D
from tidemark.operators import ensembles as N
from tidemark.operators import rules as R
from tidemark.operators import summaries as Y

from .streams import CLASSES, events, read, rounded

U = "(('0x'||substr(md5(idx||'|'||model),1,8))::BIGINT/4294967296.0)"
WEIGHTED = f"e as (select event_id as idx, user_id, list_position({CLASSES!r}, event_type)-1 as y, value from events), w as (select *, {poisson1_sql(U)} as k from e, range(10) r(model))"


def poisson_weights(spark, d):
    weighted = N.bagging_weights(events(spark, d).select("idx"), "idx", 10)
    return weighted.groupBy("model", "k").agg(F.count("*").alias("n"))


def bagging_class_counts(spark, d):
    return N.bagged_counts(N.bagging_weights(events(spark, d), "idx", 10), "y")


def vote_combine(spark, d):
    """Users are instances, event types the classes and hours of the id models: each model votes counts."""
    rows = events(spark, d).withColumn("model", F.col("idx") % 7)
    votes = rows.groupBy("user_id", "model").agg(F.array(*(F.sum((F.col("y") == c).cast("double")) for c in range(5))).alias("votes"))
    return rounded(N.combined_votes(votes, "user_id", 5), 6, *(f"v{c}" for c in range(5)))


def boosting_weights(spark, d):
    hits = events(spark, d).groupBy("user_id").agg(F.sum((F.col("y") != 1).cast("double")).alias("correct"), F.sum((F.col("y") == 1).cast("double")).alias("wrong"))
    return rounded(hits.select("user_id", N.boosting_weight(F.col("correct"), F.col("wrong")).alias("weight")), 6, "weight")


def boosting_by_user(spark, d):
    out = N.boosted(events(spark, d), "user_id", "idx", "y", 5, 5)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("pred") == F.col("y")).cast("long")).alias("hits"))


def adaptive_bagging_by_user(spark, d):
    out = N.adaptive_bagged(events(spark, d), "user_id", "idx", "y", 5, 5, D.ddm())
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("pred") == F.col("y")).cast("long")).alias("hits"), F.max("resets").alias("resets"))


RULES = [R.Rule([("l_quantity", R.AT_MOST, 10.0), ("l_discount", R.ABOVE, 0.05)]), R.Rule([("l_quantity", R.ABOVE, 40.0)]), R.Rule([("l_tax", R.AT_MOST, 0.02)])]
COVER = ["l_quantity <= 10 and l_discount > 0.05", "l_quantity > 40", "l_tax <= 0.02"]


def rule_coverage(spark, d):
    rows = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    rows = rows.select(R.first_cover(RULES).cast("int").alias("rule"), F.size(R.all_covers(RULES)).alias("covers"), "l_extendedprice")
    return rounded(rows.groupBy("rule", "covers").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean")), 2, "mean")


def _literals(spark, d):
    """Literals that the line items of a supplier give its rule: at most, and above, its quantities and discounts."""
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("rule"), (1 + F.col("l_linenumber") % 2).cast("int").alias("operator"), F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value")) for c in ("l_quantity", "l_discount")))).alias("p"))
    return rows.select("rule", "operator", "p.attribute", "p.value")


def anomaly_score(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = read(spark, d, "lineitem").select("l_returnflag", *names)
    stats = rows.groupBy("l_returnflag").agg(*(f(c).alias(f"{c}_{s}") for c in names for f, s in ((F.avg, "m"), (F.stddev_samp, "s"))))  # a row per flag
    scored = rows.join(F.broadcast(stats), "l_returnflag").select("l_returnflag", R.anomaly([F.col(c) for c in names], [F.col(f"{c}_m") for c in names], [F.col(f"{c}_s") for c in names], least=0.3).alias("score"))
    return rounded(scored.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count(F.when(F.col("score") >= 0.5, 1)).alias("odd"), F.avg("score").alias("mean")), 6, "mean")


def _votes(spark, d):
    """Each user's mean and the grand mean vote for every event; errors are the mean deviations."""
    rows = events(spark, d).select("idx", "user_id", "y", "value")
    parts = []
    for name, key in (("user", "user_id"), ("type", "y")):
        stats = rows.groupBy(key).agg(F.avg("value").alias("pred"), F.stddev_samp("value").alias("error"))
        parts.append(rows.join(stats, key).select("idx", "pred", "error"))
    return parts[0].unionByName(parts[1])


VOTES = f"e as (select event_id as idx, user_id, list_position({CLASSES!r}, event_type)-1 as y, value from events), v as (select idx, avg(value) over (partition by user_id) as pred, stddev_samp(value) over (partition by user_id) as error from e union all select idx, avg(value) over (partition by y), stddev_samp(value) over (partition by y) from e)"


def vote_inverse_error(spark, d):
    return rounded(R.inverse_error_vote(_votes(spark, d), "idx"), 4, "vote", "weighted_error")


def vote_uniform(spark, d):
    return rounded(R.uniform_vote(_votes(spark, d), "idx"), 4, "vote")


def target_mean(spark, d):
    rows = R.target_mean(events(spark, d), "user_id", "idx", "value")
    return rounded(rows.groupBy("user_id").agg(F.avg(F.abs(F.col("value") - F.col("pred"))).alias("mae")), 4, "mae")


def normalized_error(spark, d):
    rows = R.target_mean(events(spark, d), "user_id", "idx", "value")
    stats = rows.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    rows = rows.join(stats, "user_id")
    return rounded(rows.groupBy("user_id").agg(F.avg(R.normalized_error(F.col("value"), F.col("pred"), F.col("m"), F.col("s"))).alias("error")), 4, "error")


def perceptron_by_user(spark, d):
    rows = events(spark, d).withColumn("hour", (F.col("idx") % 24).cast("double"))
    out = R.perceptron(rows, "user_id", "idx", ["y", "hour"], "value")
    return rounded(out.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("error", "idx").alias("error")), 4, "error")


def _amrules(ordered: bool):
    def query(spark, d):
        rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"), F.year("o_orderdate").cast("double").alias("year"), (F.col("o_custkey") % 97).cast("double").alias("band"))
        model = R.AMRules(["day", "year", "band"], {"day": (1.0, 367.0), "year": (1990.0, 2002.0), "band": (0.0, 97.0)}, ordered=ordered)
        for k in range(5):
            model.learn(rows.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(5)) == k), "o_totalprice")
        out = model.predict(rows)
        return rounded(out.groupBy("rule").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("o_totalprice") - F.col("pred"))).alias("mae")), 2, "mae")

    return query


QUERIES = {
    "poisson_weights": poisson_weights, "bagging_class_counts": bagging_class_counts, "vote_combine": vote_combine, "boosting_weights": boosting_weights, "boosting_by_user": boosting_by_user,
    "adaptive_bagging_by_user": adaptive_bagging_by_user, "rule_coverage": rule_coverage, "rule_tighten": lambda s, d: R.tightened(_literals(s, d)), "anomaly_score": anomaly_score,
    "vote_inverse_error": vote_inverse_error, "vote_uniform": vote_uniform, "target_mean": target_mean, "normalized_error": normalized_error, "perceptron_by_user": perceptron_by_user,
    "amrules_ordered": _amrules(True), "amrules_unordered": _amrules(False),
}

_TM = "t as (select event_id, user_id, value, coalesce(avg(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding),0) as pred from events)"
_AN = ["l_quantity", "l_extendedprice", "l_discount"]
SQL = {
    "poisson_weights": f"with {WEIGHTED} select model::int as model, k, count(*) as n from w group by 1,2",
    "bagging_class_counts": f"with {WEIGHTED} select model::int as model, y, sum(k)::bigint as weight from w where k > 0 group by 1,2",
    "vote_combine": f"with e as (select user_id, event_id % 7 as model, list_position({CLASSES!r}, event_type)-1 as y from events), m as (select user_id, model, count(*)::double as n, " + ", ".join(f"count(*) filter (y={c}) as n{c}" for c in range(5)) + " from e group by 1,2) select user_id, " + ", ".join(f"round(sum(n{c}/n),6)+0.0 as v{c}" for c in range(5)) + " from m group by 1",
    "boosting_weights": "with h as (select user_id, count(*) filter (event_type<>'error')::double as r, count(*) filter (event_type='error')::double as w from events group by 1) select user_id, round(case when w > 0 and w/(r+w) <= 0.5 then ln((1-w/(r+w))/(w/(r+w))) else 0 end,6)+0.0 as weight from h",
    "rule_coverage": f"with c as (select case when {COVER[0]} then 0 when {COVER[1]} then 1 when {COVER[2]} then 2 else -1 end as rule, ({COVER[0]})::int + ({COVER[1]})::int + ({COVER[2]})::int as covers, l_extendedprice as x from lineitem) select rule, covers, count(*) as n, round(avg(x),2)+0.0 as mean from c group by 1,2",
    "rule_tighten": "with l as (select l_suppkey as rule, (1 + l_linenumber % 2)::int as operator, unnest([{'a': 'l_quantity', 'v': l_quantity}, {'a': 'l_discount', 'v': l_discount}]) as p from lineitem) select rule, p.a as attribute, operator, (case when operator=1 then min(p.v) else max(p.v) end)::double as value from l group by 1,2,3",
    "anomaly_score": "with s as (select *, " + ", ".join(f"1/(1+power(({c}-avg({c}) over p)/stddev_samp({c}) over p,2)) as p_{c}" for c in _AN) + " from lineitem window p as (partition by l_returnflag)), t as (select l_returnflag, " + "+".join(f"abs(ln(p_{c}))" for c in _AN) + " as a, " + "+".join(f"case when p_{c} < 0.3 then abs(ln(p_{c})) else 0 end" for c in _AN) + " as o from s), u as (select l_returnflag, case when a > 0 then o/a else 0 end as score from t) select l_returnflag, count(*) as n, count(*) filter (score >= 0.5) as odd, round(avg(score),6) as mean from u group by 1",
    "vote_inverse_error": f"with {VOTES} select idx, round(sum(pred/(error+1e-9))/sum(1/(error+1e-9)),4)+0.0 as vote, round(sum(error/(error+1e-9))/sum(1/(error+1e-9)),4)+0.0 as weighted_error from v group by 1",
    "vote_uniform": f"with {VOTES} select idx, round(avg(pred),4)+0.0 as vote from v group by 1",
    "target_mean": f"with {_TM} select user_id, round(avg(abs(value-pred)),4) as mae from t group by 1",
    "normalized_error": f"with {_TM}, s as (select user_id, value, pred, avg(value) over (partition by user_id) as m, stddev_samp(value) over (partition by user_id) as s from t) select user_id, round(avg(case when s > 1e-7 then abs((value-m)/s-(pred-m)/s) else abs(value-pred) end),4) as error from s group by 1",
}
OBSERVED = ["l_quantity", "l_discount", "l_tax"]


def class_cut_points(spark, d):
    """Ten quantiles of each class of each attribute as cuts, and the rows of every class on either side, from merged summaries."""
    rows = read(spark, d, "lineitem").select("l_returnflag", *OBSERVED).repartition(6)
    return Y.class_cuts(Y.summarised(rows, OBSERVED, "l_returnflag", 100, 3), 10)


QUERIES["class_cut_points"] = class_cut_points
_OBSERVED = " union all ".join(f"select '{a}' as attribute, l_returnflag as class, {a} as v from lineitem" for a in OBSERVED)
SQL["class_cut_points"] = f"with t as ({_OBSERVED}), g as (select attribute, class, v, count(*) as m from t group by 1, 2, 3), c as (select attribute, class, v, sum(m) over (partition by attribute, class order by v) as up, sum(m) over (partition by attribute, class) as n from g), k as (select distinct attribute, cut from (select attribute, class, j, min(v) as cut from c, range(1, 11) r(j) where up >= n*j/11.0 - 1e-9 group by 1, 2, 3)) select k.attribute, k.cut, class, count(*) filter (v <= cut)::double as below, count(*) filter (v > cut)::double as above from k join t using (attribute) group by 1, 2, 3"
