"""Queries for trees and ensembles of trees over micro-batches, with SQL that grows the same trees batch by batch."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_cdf_sql, poisson1_sql
from tidemark.operators import drift as D
from tidemark.operators.forest import Forest, prequential
from tidemark.storage import fresh_folder, kept, removed
from tidemark.streaming import models

from .streams import read

BATCHES, MODELS = 6, 3
NUMERIC, NOMINAL = ["price", "month"], ["priority", "status"]
OPTIONS = {"grace": 100, "delta": 0.01, "tie": 0.1, "binary": True}


def orders(spark, d, turn: bool = False):
    """Orders whose class follows price and priority, but for one in ten; with `turn` the rule is the opposite in the second half."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("price"), F.month("o_orderdate").cast("double").alias("month"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    rule = ((F.col("price") > 250000) == (F.col("priority") < "3")) == (F.col("idx") % 10 != 0)
    if turn:
        half = rows.agg(F.max("idx")).first()[0] / 2
        rule = rule == (F.col("idx") < half)
    return rows.withColumn("y", rule.cast("int"))


def _total(out):
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.sum("pred").cast("long").alias("ones"), F.count(F.when(F.col("pred") == F.col("y"), 1)).alias("hits"))


def _query(kind: str, turn: bool = False):
    def query(spark, d):
        adaptive = kind == "adaptive"
        forest = Forest(["0", "1"], NUMERIC, NOMINAL, MODELS, kind, D.rising() if adaptive else None, **OPTIONS)
        folder = fresh_folder(spark, kind)
        out = kept(_total(prequential(orders(spark, d, turn), forest, "idx", "y", BATCHES, folder)), f"{kind}-result")
        removed(spark, folder)
        return out

    return query


def tree_stream(spark, d):
    """One tree that learns a stream of orders, a file a micro-batch, from a store that counts every batch once."""
    folder = fresh_folder(spark, "tree")
    rows = orders(spark, d)
    low, high = rows.agg(F.min("idx"), F.max("idx")).first()
    width = -(-(high - low + 1) // BATCHES)
    for k in range(BATCHES):
        rows.where((F.col("idx") >= low + k * width) & (F.col("idx") < low + (k + 1) * width)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = models.Store(spark, f"{folder}/store")
    models.learn(stream, Forest(["0", "1"], NUMERIC, NOMINAL, **OPTIONS), store, "idx", "y", f"{folder}/checkpoint").awaitTermination()
    out = kept(_total(store.rows()), "tree-result")
    removed(spark, folder)
    return out


QUERIES = {"bagged_trees": _query("bagging"), "adaptive_bagged_trees": _query("adaptive", turn=True), "boosted_trees": _query("boosting"), "tree_stream": tree_stream}


def _bits(a: str, b: str) -> str:
    """Bits of two weights, and 0 for none."""
    x = lambda c: f"(case when {c} > 0 then {c}*log2({c}) else 0 end)"
    return f"(case when {a}+{b} > 0 then log2({a}+{b}) - ({x(a)}+{x(b)})/({a}+{b}) else 0 end)"


_MERIT = f"case when l0+l1 > 0.01*(l0+l1+r0+r1) and r0+r1 > 0.01*(l0+l1+r0+r1) then {_bits('(l0+r0)', '(l1+r1)')} - ((l0+l1)*{_bits('l0', 'l1')} + (r0+r1)*{_bits('r0', 'r1')})/(l0+l1+r0+r1) end"
_PHI = "(case when abs({0}) > 40 then ({0} > 0)::int else {1} end)"


def _forest_sql(kind: str, turn: bool = False) -> str:
    """Trees of two classes grown in BATCHES steps: a node's children are named by its number with a 1 or a 2 appended.

    Of each step: routes by as many joins as the depth can be, votes of the leaves as they stand, weights, sums by
    leaf, attribute and class, merits of all cuts, splits; of an adaptive ensemble the detector's step as well.
    """
    count, grace = (1, OPTIONS["grace"]) if kind == "single" else (MODELS, OPTIONS["grace"])
    u = "(('0x'||substr(md5(idx||'|'||k),1,8))::bigint/4294967296.0)"
    rule = "((price > 250000) = (priority < '3')) = (idx % 10 <> 0)"
    rule = f"(({rule}) = (idx < half))" if turn else f"({rule})"
    out = [
        "o as (select o_orderkey as idx, o_totalprice as price, month(o_orderdate)::double as month, o_orderpriority as priority, o_orderstatus as status, (select max(o_orderkey)/2.0 from orders) as half, (select min(o_orderkey) from orders) as low, ceil((select max(o_orderkey)-min(o_orderkey)+1 from orders)/{0}.0)::bigint as width from orders)".format(BATCHES),
        f"r as materialized (select idx, price, month, priority, status, ((idx-low)//width)::int as b, {rule}::int as y from o)",
        f"m as (select range::int as k from range({count}))",
        "split0 as (select 0 as k, 0::bigint as id, '' as a, 0.0::double as cut, '' as val where false)",
        "leaf0 as (select k, 1::bigint as id, 0.0::double as c0, 0.0::double as c1, 0.0::double as checked from m)",
        "root0 as (select k, 1::bigint as root from m)",
        "sums0 as (select k, 0.0::double as good, 0.0::double as bad from m)",
        "num0 as (select 0 as k, 0::bigint as id, '' as a, 0 as y, 0.0::double as n, 0.0::double as s, 0.0::double as q, 0.0::double as lo, 0.0::double as hi where false)",
        "nom0 as (select 0 as k, 0::bigint as id, '' as a, '' as v, 0.0::double as n0, 0.0::double as n1 where false)",
        "det0 as (select k, 0.0::double as n, 0.0::double as mean, 0.0::double as est from m)",
    ]
    for t in range(BATCHES):
        add = lambda name, text: out.append(f"{name} as materialized ({text})")  # noqa: E731, B023
        add(f"w{t}_0", f"select r.*, k, root as cur from r, m join root{t} using (k) where b = {t}")
        for i in range(t):
            left = "case when s.a = 'price' then w.price <= s.cut when s.a = 'month' then w.month <= s.cut when s.a = 'priority' then w.priority = s.val else w.status = s.val end"
            add(f"w{t}_{i + 1}", f"select w.* replace (case when s.id is null then w.cur else w.cur*10 + case when {left} then 1 else 2 end end as cur) from w{t}_{i} w left join split{t} s on s.k = w.k and s.id = w.cur")
        add(f"p{t}", f"select w.*, c0, c1, (c1 > c0)::int as own from w{t}_{t} w join leaf{t} l on l.k = w.k and l.id = w.cur")
        vote = "case when bad > 0 and bad/(good+bad) <= 0.5 then ln((1-bad/(good+bad))/(bad/(good+bad))) else 0 end" if kind == "boosting" else "1"
        share = lambda c: f"sum(case when c0+c1 > 0 then ({vote})*{c}/(c0+c1) else 0 end)"  # noqa: E731, B023
        add(f"pred{t}", f"select idx, any_value(y) as y, any_value(b) as b, (round({share('c1')},9) > round({share('c0')},9))::int as pred from p{t} join sums{t} using (k) group by idx")
        if kind == "single":
            add(f"x{t}", f"select *, 1.0::double as w, 1.0::double as rate from p{t}")
        elif kind == "boosting":
            # the rate of a row after each model, from its sums before the batch and the row itself
            add(f"z{t}_0", f"select *, 1.0::double as rate from p{t} where k = 0")
            after = "rate * (good+bad+rate) / (2*(case when own = y then good else bad end + rate))"
            for k in range(1, count):
                add(f"z{t}_{k}", f"select p.*, e.next as rate from p{t} p join (select idx, {after} as next from z{t}_{k - 1} join sums{t} using (k)) e using (idx) where k = {k}")
            terms = "list_transform(range(0, 40), lambda j: exp(-rate + j*ln(rate) - lgamma(j+1)))"
            add(f"x{t}", f"select * exclude (terms), list_sum(list_transform(range(1, 41), lambda j: (list_sum(terms[1:j]) <= {u})::int))::double as w from (select *, {terms} as terms from ({' union all by name '.join(f'select * from z{t}_{k}' for k in range(count))}))")
        else:
            add(f"x{t}", f"select *, ({poisson1_sql(u)})::double as w, 1.0::double as rate from p{t}")
        add(f"sums{t + 1}", f"select s.k, good + coalesce(g, 0) as good, bad + coalesce(h, 0) as bad from sums{t} s left join (select k, sum(rate) filter (own = y) as g, sum(rate) filter (own <> y) as h from x{t} group by k) using (k)" if kind == "boosting" else f"select * from sums{t}")
        add(f"got{t}", f"select * from x{t} where w > 0")
        add(f"seen{t}", f"select l.k, l.id, l.c0 + coalesce(g0, 0) as c0, l.c1 + coalesce(g1, 0) as c1, checked from leaf{t} l left join (select k, cur as id, coalesce(sum(w) filter (y = 0), 0) as g0, coalesce(sum(w) filter (y = 1), 0) as g1 from got{t} group by all) using (k, id)")
        tall = " union all ".join(f"select k, cur as id, '{a}' as a, y, sum(w) as n, sum(w*{a}) as s, sum(w*{a}*{a}) as q, min({a}) as lo, max({a}) as hi from got{t} group by all" for a in NUMERIC)
        add(f"num{t + 1}", f"select k, id, a, y, sum(n) as n, sum(s) as s, sum(q) as q, min(lo) as lo, max(hi) as hi from (select * from num{t} union all {tall}) group by all")
        tall = " union all ".join(f"select k, cur as id, '{a}' as a, {a} as v, coalesce(sum(w) filter (y = 0), 0) as n0, coalesce(sum(w) filter (y = 1), 0) as n1 from got{t} group by all" for a in NOMINAL)
        add(f"nom{t + 1}", f"select k, id, a, v, sum(n0) as n0, sum(n1) as n1 from (select * from nom{t} union all {tall}) group by all")
        add(f"due{t}", f"select *, c0+c1 as seen from seen{t} where c0+c1-checked >= {grace} and c0 > 0 and c1 > 0")
        add(f"at{t}", f"select k, id, a, j, f + (g-f)*j/11.0 as cut from (select k, id, a, min(lo) as f, max(hi) as g from num{t + 1} semi join due{t} using (k, id) group by all), range(1, 11) r(j)")
        z = "((cut-s/n)/sqrt(v))"
        below = f"case when cut < lo then 0.0 when cut >= hi then n when v > 0 then n*{_PHI.format(z, normal_cdf_sql(z))} else n*(cut >= s/n)::int end"
        add(f"cuts{t}", f"select k, id, a, j, cut, y, n, {below} as below from at{t} join (select *, case when n > 1 then greatest(q-s*s/n, 0)/(n-1) else 0 end as v from num{t + 1}) using (k, id, a)")
        both = lambda c: ", ".join(f"coalesce(sum({e}) filter (y = {i}), 0) as {c}{i}" for i in (0, 1) for e in (["below"] if c == "l" else ["n-below"]))
        numeric = f"select k, id, a, cut, '' as val, lpad(j::varchar, 2, '0') as tie, {both('l')}, {both('r')} from cuts{t} group by all"
        nominal = f"select k, id, a, null as cut, v as val, v as tie, n0 as l0, n1 as l1, sum(n0) over of - n0 as r0, sum(n1) over of - n1 as r1 from nom{t + 1} semi join due{t} using (k, id) window of as (partition by k, id, a)"
        add(f"merit{t}", f"select *, {_MERIT} as merit from (select k, id, a, cut, val, tie, l0, l1, r0, r1 from ({numeric} union all {nominal}))")
        add(f"best{t}", f"select *, row_number() over (partition by k, id order by merit desc) as place, lead(merit) over (partition by k, id order by merit desc) as second from (select * from merit{t} where merit is not null qualify row_number() over (partition by k, id, a order by merit desc, tie) = 1)")
        epsilon = f"sqrt({math.log(1 / OPTIONS['delta'])!r}/(2*seen))"
        add(f"new{t}", f"select b.* from best{t} b join due{t} using (k, id) where place = 1 and merit > 0 and (merit - greatest(coalesce(second, 0), 0) > {epsilon} or {epsilon} < {OPTIONS['tie']})")
        fallen, child = "", f"select k, id*10+1 as id, l0 as c0, l1 as c1, l0+l1 as checked from new{t} union all select k, id*10+2, r0, r1, r0+r1 from new{t}"
        if kind == "adaptive":
            bar, fade = D.RISE, D.FADE
            add(f"err{t}", f"select k, avg((own <> y)::double) as x from x{t} group by k")
            # one step a batch: the detector's mean, its estimate before, and whether both bars are passed
            add(f"step{t}", f"select d.k, d.n, d.mean, d.est, x, case when d.n > 0 and x > d.mean + {bar} and x > d.est then 1 else 0 end as fell from det{t} d join err{t} using (k)")
            add(f"det{t + 1}", f"select k, case when fell = 1 then 0 else {fade}*n+1 end as n, case when fell = 1 then 0 else ({fade}*n*mean+x)/({fade}*n+1) end as mean, case when fell = 1 then 0 else x end as est from step{t}")
            add(f"root{t + 1}", f"select r.k, root + fell as root from root{t} r join step{t} using (k)")
            fallen = f" where k not in (select k from step{t} where fell = 1) union all select r.k, r.root, 0.0, 0.0, 0.0 from root{t + 1} r join step{t} using (k) where fell = 1"
        else:
            add(f"root{t + 1}", f"select * from root{t}")
        add(f"leaf{t + 1}", f"select * from (select s.k, s.id, s.c0, s.c1, case when d.id is null then s.checked else s.c0+s.c1 end as checked from seen{t} s left join due{t} d using (k, id) anti join new{t} using (k, id) union all {child}){fallen}")
        add(f"split{t + 1}", f"select * from split{t} union all select k, id, a, cut, val from new{t}")
    every = " union all ".join(f"select * from pred{t}" for t in range(BATCHES))
    return f"with {', '.join(out)} select b as batch, count(*) as n, sum(pred)::bigint as ones, count(*) filter (pred = y) as hits from ({every}) group by b"


SQL = {"bagged_trees": _forest_sql("bagging"), "adaptive_bagged_trees": _forest_sql("adaptive", turn=True), "boosted_trees": _forest_sql("boosting"), "tree_stream": _forest_sql("single")}
