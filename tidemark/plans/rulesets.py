"""Queries for replicated rule sets and for sets of many rules, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators.forest import batched
from tidemark.operators.rules import ABOVE, AT_MOST, Rule
from tidemark.operators.rulesets import RuleSet, covered
from tidemark.storage import fresh_folder, kept, removed

from .streams import read, rounded

BATCHES = 6
RANGES = {"l_quantity": (0.0, 50.0), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08)}
OPTIONS = {"grace": 200, "delta": 1e-3, "tie": 0.1, "bins": 10, "rise": 0.5, "fade": 0.8, "predictor": "mean", "anomalies": False}
_TARGET = "case when l_quantity > 25 then case when l_orderkey > {0} then 10 else 100 end else 20 end + case when l_discount > 0.05 then 30 else 0 end + l_linenumber % 3"


def _rule_log(ordered: bool):
    def query(spark, d):
        """The log of rules, literals and rules that went, on a target that turns in the last third of the orders."""
        rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *RANGES)
        turn = rows.agg(F.max("l_orderkey")).first()[0] * 2 // 3
        rules, folder = RuleSet(list(RANGES), RANGES, ordered=ordered, **OPTIONS), fresh_folder(spark, "rules")
        batched(rows.withColumn("y", F.expr(_TARGET.format(turn)).cast("double")), rules, "l_orderkey", "y", BATCHES, folder)
        out = kept(rules.logged(spark), "rules-log")
        removed(spark, folder)
        return rounded(out.na.fill({"attribute": "", "operator": "", "cut": -1.0}), 6, "cut")

    return query


MANY = 10_000


def many_rules(spark, d):
    """MANY rules of three literals on all line items: how many rows a rule is the first to cover, and how many cover these."""
    rules = [Rule([("l_quantity", AT_MOST, 1.0 + k % 50), ("l_extendedprice", ABOVE, float(k * 7919 % 100_000)), ("l_discount", AT_MOST, (k % 11) / 100)]) for k in range(MANY)]
    out = covered(read(spark, d, "lineitem"), rules, ["l_orderkey"])
    return out.groupBy("rule").agg(F.count("*").alias("n"), F.sum("covers").cast("long").alias("covers"), F.max("l_orderkey").alias("last"))


QUERIES = {"rule_log_ordered": _rule_log(True), "rule_log_unordered": _rule_log(False), "many_rules": many_rules}


def _rule_log_sql(ordered: bool) -> str:
    """Six versions of the rule table, each from the one before and a batch: covers, sums by bin, change test, best cuts, changes."""
    bins, names = OPTIONS["bins"], list(RANGES)
    bounds = [f"{side}{a}" for a in range(3) for side in "lh"]
    free = ", ".join(f"{'-' if b[0] == 'l' else ''}1e300::double as {b}" for b in bounds)
    sd = lambda n, s, q: f"sqrt(greatest({q}-{s}*{s}/{n}, 0)/{n})"
    out = [
        "mm as (select min(l_orderkey) as low, max(l_orderkey) as high, max(l_orderkey)*2//3 as turn from lineitem)",
        f"r as materialized (select row_number() over () as row, (l_orderkey-low)//ceil((high-low+1)/{BATCHES}.0)::bigint as b, {', '.join(f'{n} as x{a}' for a, n in enumerate(names))}, ({_TARGET.format('turn')})::double as y from lineitem, mm)",
        # rule 0 is the default; gen tells what has been learned since the last change from what went before
        f"rule0 as (select 0 as id, 0 as gen, {free}, 0.0::double as bn, 0.0::double as bs, 0.0::double as tn, 0.0::double as tm, 0.0::double as u)",
        "made0 as (select 0 as made)",
        "tot0 as (select 0 as id, 0 as gen, 0.0::double as n, 0.0::double as s, 0.0::double as q where false)",
        "cell0 as (select 0 as id, 0 as gen, 0 as a, 0 as bin, 0.0::double as n, 0.0::double as s, 0.0::double as q where false)",
    ]
    for t in range(BATCHES):
        add = lambda name, text: out.append(f"{name} as materialized ({text})")  # noqa: E731, B023
        inside = " and ".join(f"x{a} > l{a} and x{a} <= h{a}" for a in range(3))
        add(f"hit{t}", f"select row, id from (select * from r where b = {t}) r join rule{t} on id > 0 and {inside}")
        chosen = f"select row, min(id) as id from hit{t} group by 1" if ordered else f"select * from hit{t}"
        add(f"at{t}", f"select r.*, coalesce(c.id, 0) as id from (select * from r where b = {t}) r left join ({chosen}) c using (row)")
        add(f"known{t}", f"select k.*, coalesce(n, 0) as n, coalesce(s, 0) as s, coalesce(q, 0) as q, case when n > 1 then sqrt(greatest(q-s*s/n, 0)/(n-1)) else 0 end as sd, case when bn+coalesce(n, 0) > 0 then (bs+coalesce(s, 0))/(bn+coalesce(n, 0)) else 0 end as mean from rule{t} k left join tot{t} using (id, gen)")
        add(f"step{t}", f"select id, gen, tn, tm, u, count(*) as rows, sd, avg(case when sd > 1e-7 then abs(y-mean)/sd end) as x from at{t} join known{t} using (id) group by all")
        add(f"gone{t}", f"select id from step{t} where id > 0 and sd > 1e-7 and tn > 0 and x > tm + {OPTIONS['rise']}")
        add(f"got{t}", f"select a.*, gen from at{t} a join rule{t} using (id) anti join gone{t} using (id)")
        add(f"tot{t + 1}", f"select id, gen, sum(n) as n, sum(s) as s, sum(q) as q from (select * from tot{t} union all select id, gen, count(*), sum(y), sum(y*y) from got{t} group by all) group by all")
        tall = " union all ".join(f"select id, gen, {a} as a, greatest(least(ceil((x{a}-{lo!r})/{hi - lo!r}*{bins})::int-1, {bins - 1}), 0) as bin, count(*) as n, sum(y) as s, sum(y*y) as q from got{t} group by all" for a, (lo, hi) in enumerate(RANGES.values()))
        add(f"cell{t + 1}", f"select id, gen, a, bin, sum(n) as n, sum(s) as s, sum(q) as q from (select * from cell{t} union all {tall}) group by all")
        add(f"due{t}", f"select id, gen, n as total from step{t} join tot{t + 1} using (id, gen) anti join gone{t} using (id) where u + rows >= {OPTIONS['grace']}")
        of = "over (partition by id, gen, a order by bin)"
        whole = "over (partition by id, gen, a)"
        add(f"cum{t}", f"select id, gen, a, bin, sum(n) {of} as bn, sum(s) {of} as bs, sum(q) {of} as bq, sum(n) {whole} as n, sum(s) {whole} as s, sum(q) {whole} as q from cell{t + 1} semi join due{t} using (id, gen)")
        add(f"side{t}", f"select *, n-bn as an, s-bs as as_, {sd('bn', 'bs', 'bq')} as bsd, {sd('(n-bn)', '(s-bs)', '(q-bq)')} as asd from cum{t} where least(bn, n-bn) >= greatest(0.05*n, 1e-9)")
        add(f"cut{t}", f"select *, {sd('n', 's', 'q')} - bn/n*bsd - an/n*asd as merit from side{t} qualify row_number() over (partition by id, gen, a order by round({sd('n', 's', 'q')} - bn/n*bsd - an/n*asd, 9) desc, bin) = 1")
        add(f"best{t}", f"select *, row_number() over w as place, lead(merit) over w as second from cut{t} window w as (partition by id, gen order by round(merit, 9) desc, a)")
        bound = f"sqrt({math.log(1 / OPTIONS['delta'])!r}/(2*total))"
        low = " ".join(f"when {a} then {lo!r}+{hi - lo!r}*(bin+1)/{bins}" for a, (lo, hi) in enumerate(RANGES.values()))
        add(f"pick{t}", f"select *, case a {low} end as cut, bsd <= asd as below from best{t} join due{t} using (id, gen) where place = 1 and merit > 0 and (second is null or second/merit + {bound} < 1 or {bound} < {OPTIONS['tie']})")
        moved = ", ".join(f"case when p.id is not null and p.a = {a} and {'not ' if side == 'l' else ''}p.below then {'greatest' if side == 'l' else 'least'}({side}{a}, p.cut) else {side}{a} end as {side}{a}" for a in range(3) for side in "lh")
        changed = " or ".join(f"m.{b} <> k.{b}" for b in bounds)
        add(f"moved{t}", f"select k.id, p.id is not null as picked, {moved}, p.a, p.below, p.cut, p.bn as pbn, p.bs as pbs, p.an as pan, p.as_ as pas from rule{t} k left join pick{t} p on p.id = k.id where k.id > 0")
        add(f"lit{t}", f"select m.* from moved{t} m join rule{t} k using (id) where picked and ({changed})")
        add(f"new{t}", f"select made + 1 as id, p.* exclude (id) from pick{t} p, made{t} where p.id = 0")
        add(f"made{t + 1}", f"select made + (select count(*) from new{t}) as made from made{t}")
        spent = f"case when k.u + coalesce(st.rows, 0) >= {OPTIONS['grace']} then 0 else k.u + coalesce(st.rows, 0) end"
        tested = "st.rows is not null and st.sd > 1e-7 and k.id > 0"
        base = "case when m.below then m.p{0} else m.{1} end"
        fresh = ", ".join(f"case when {a} = a and {'not ' if side == 'l' else ''}below then cut else {'-' if side == 'l' else ''}1e300 end as {side}{a}" for a in range(3) for side in "lh")
        rules = (
            f"select k.id, case when m.id is null then k.gen else k.gen+1 end as gen, {', '.join(f'coalesce(m.{b}, k.{b}) as {b}' for b in bounds)}, case when m.id is null then k.bn else {base.format('bn', 'pan')} end as bn, case when m.id is null then k.bs else {base.format('bs', 'pas')} end as bs, "
            f"case when m.id is not null then 0 when {tested} then {OPTIONS['fade']}*k.tn+1 else k.tn end as tn, case when m.id is not null then 0 when {tested} then ({OPTIONS['fade']}*k.tn*k.tm+st.x)/({OPTIONS['fade']}*k.tn+1) else k.tm end as tm, case when m.id is not null then 0 else {spent} end as u "
            f"from rule{t} k left join step{t} st on st.id = k.id left join lit{t} m on m.id = k.id where k.id > 0 and k.id not in (select id from gone{t})"
        )
        default = f"select 0 as id, case when n.id is null then k.gen else k.gen+1 end, {free}, case when n.id is null then k.bn when n.below then n.an else n.bn end, case when n.id is null then k.bs when n.below then n.as_ else n.bs end, 0.0, 0.0, case when n.id is not null then 0 else {spent} end from rule{t} k left join step{t} st on st.id = k.id left join new{t} n on true where k.id = 0"
        made = f"select id, 0 as gen, {fresh}, case when below then bn else an end, case when below then bs else as_ end, 0.0, 0.0, 0.0 from new{t}"
        add(f"rule{t + 1}", f"{rules} union all {default} union all {made}")
    name = " ".join(f"when {a} then '{n}'" for a, n in enumerate(names))
    sign = "case when below then '<=' else '>' end"
    log = " union all ".join(f"select {t} as batch, 'removed' as event, id as rule, '' as attribute, '' as operator, -1.0::double as cut from gone{t} union all select {t}, 'literal', id, case a {name} end, {sign}, cut from lit{t} union all select {t}, 'new', id, case a {name} end, {sign}, cut from new{t}" for t in range(BATCHES))
    return f"with {', '.join(out)} select batch::int as batch, event, rule::int as rule, attribute, operator, round(cut, 6) as cut from ({log})"


SQL = {
    "rule_log_ordered": _rule_log_sql(True), "rule_log_unordered": _rule_log_sql(False),
    "many_rules": f"with k as (select range as k, 1.0+range%50 as q, (range*7919%100000)::double as p, (range%11)/100.0 as d from range({MANY})), i as (select row_number() over () as row, l_orderkey, l_quantity, l_extendedprice, l_discount from lineitem), c as (select row, min(k) as rule, count(*) as covers from i join k on l_quantity <= q and l_extendedprice > p and l_discount <= d group by 1) select coalesce(rule, -1)::int as rule, count(*) as n, coalesce(sum(covers), 0)::bigint as covers, max(l_orderkey) as last from i left join c using (row) group by 1",
}
