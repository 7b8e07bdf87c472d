"""Drift queries: every detector per user of the event stream, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators.observers import summarised

from .streams import read, rounded


#: Means of few values with two decimals often lie half way between two rounded numbers, where engines differ.
NUDGE = 1e-7


def _by_user(detector, error: bool):
    def query(spark, d):
        x = (F.col("event_type") == "error").cast("double") if error else F.col("value")
        rows = read(spark, d, "events").select("user_id", "event_id", x.alias("x"))
        out = D.summary(D.detect(rows, "user_id", "event_id", "x", detector()), "user_id", "event_id")
        return rounded(out.withColumn("estimate", F.col("estimate") + NUDGE), 4, "estimate")

    return query


BIG = repr(D.BIG)


def _sql(x: str, init: dict[str, str], stages: list[dict[str, str]], change: str, warning: str, estimate: str) -> str:
    """One row per user and step; `stages` overwrite state columns one after the other."""
    names = list(init)
    start = ", ".join(f"{v}::double as {k}" for k, v in init.items())
    body = "(select st.user_id, o.rn, o.x, " + ", ".join(f"case when st.chg then {v}::double else st.{k} end as {k}" for k, v in init.items()) + ", st.changes, st.warnings from st join o on o.user_id = st.user_id and o.rn = st.rn + 1)"
    extra: list[str] = []
    for stage in stages:
        kept = [n for n in [*names, *extra] if n not in stage]
        extra += [n for n in stage if n not in names and n not in extra]
        body = f"(select user_id, rn, x, changes, warnings, {', '.join([*kept, *(f'({v})::double as {k}' for k, v in stage.items())])} from {body})"
    body = f"(select *, ({change}) as chg from {body})"
    body = f"(select *, (not chg and ({warning})) as warn from {body})"
    return f"""with recursive o as (select user_id, {x}::double as x, row_number() over (partition by user_id order by event_id) as rn from events),
 st as (select distinct user_id, 0::bigint as rn, {start}, false as chg, 0::bigint as changes, 0::bigint as warnings, 0.0::double as estimate from o
 union all select user_id, rn, {', '.join(names)}, chg, changes + chg::int, warnings + warn::int, ({estimate})::double from {body})
 select user_id, changes, warnings, round(estimate+1e-7::double,4) as estimate from st qualify row_number() over (partition by user_id order by rn desc) = 1"""


ERROR, VALUE = "(event_type='error')::int", "value"
MEAN = {"n": "1", "mean": "0", "total": "0"}


def _mean_sum(x: str, move: str, bar: str) -> str:
    return _sql(x, MEAN, [{"mean": "mean + (x-mean)/n"}, {"total": move, "n": "n+1"}], f"n >= 30 and total > {bar}", "false", "mean")


def _ph(x: str, fade: float) -> str:
    init = {"n": "0", "total": "0", "steps": "0", "moved": "0", "low": BIG}
    return _sql(x, init, [{"n": f"1+{fade}*n", "total": f"abs(x)+{fade}*total", "steps": "steps+1"}, {"moved": "moved + (abs(x) - total/n - 0.005)"}, {"low": "least(low, moved)"}], "steps > 30 and moved - low > 35", "false", "total/n")


def _adwin(x: str, delta: float = 0.002, buckets: int = 5, clock: int = 32, width: int = 10, part: int = 5) -> str:
    """The adaptive window by phases: a value comes, full levels are squeezed one by one, and at every `clock`-th value cuts are sought.

    The window is a list of buckets, oldest first; a level's buckets lie side by side.
    """
    size = "list_sum(list_transform(b, lambda z: z.n))"
    totals = "list_reduce(list_reverse(b), lambda a, c: {'n': a.n+c.n, 's': a.s+c.s, 'v': a.v+c.v+a.n*c.n*power(a.s/a.n-c.s/c.n, 2)/(a.n+c.n)})"
    full = f"list_min(list_filter([z.n for z in b], lambda m: len(list_filter(b, lambda z: z.n = m)) > {buckets}))"
    squeezed = "b[1:p-1] || [{'n': 2*w, 's': b[p].s+b[p+1].s, 'v': b[p].v+b[p+1].v+power(b[p].s-b[p+1].s, 2)/(2*w)}] || b[p+2:]"
    log = f"ln(2*ln(t.n)/{delta})"
    m = f"(1/(n0-{part}+1)+1/(t.n-n0-{part}+1))"
    n0, s0 = "list_sum([z.n for z in b[1:i]])", "list_sum([z.s for z in b[1:i]])"
    apart = f"abs({s0}/{n0} - (t.s-{s0})/(t.n-{n0})) > sqrt(2*{m.replace('n0', n0)}*t.v/t.n*{log}) + 2.0/3*{log}*{m.replace('n0', n0)}"
    cut = f"len(list_filter(range(1, len(b)), lambda i: {n0} >= {part + 1} and t.n-{n0} >= {part + 1} and {apart})) > 0"
    return f"""with recursive o as (select user_id, {x}::double as x, row_number() over (partition by user_id order by event_id) as rn from events),
 st as (select distinct user_id, 0::bigint as rn, 'next' as phase, []::struct(n double, s double, v double)[] as b, false as chg, 0::bigint as changes from o
 union all select user_id, rn, case phase when 'next' then 'squeeze' when 'squeeze' then case when w is not null then 'squeeze' when rn % {clock} = 0 and {size} > {width} then 'check' else 'next' end else case when cut and {size}-b[1].n > {width} then 'check' else 'next' end end,
  case when phase = 'next' then b || [{{'n': 1.0::double, 's': x, 'v': 0.0::double}}] when phase = 'squeeze' then case when w is not null then {squeezed} else b end when cut then b[2:] else b end,
  case when phase = 'next' then false when phase = 'check' then chg or cut else chg end, case when phase = 'check' and cut and not chg then changes+1 else changes end
  from (select *, case when phase = 'check' then {cut} else false end as cut, case when w is not null then list_position([z.n for z in b], w) end as p
   from (select *, case when phase = 'squeeze' then {full} end as w, case when phase = 'check' then {totals} end as t
    from (select st.user_id, case when phase = 'next' then o.rn else st.rn end as rn, phase, b, chg, changes, o.x from st left join o on o.user_id = st.user_id and o.rn = st.rn+1 and phase = 'next' where phase <> 'next' or o.x is not null)))),
 last_ as (select * from st where phase = 'next' and rn > 0 qualify row_number() over (partition by user_id order by rn desc) = 1)
 select user_id, changes, 0::bigint as warnings, round((select t.s/t.n from (select {totals} as t))+1e-7::double, 4) as estimate from last_"""


QUERIES = {
    "ddm_by_user": _by_user(D.ddm, True), "eddm_by_user": _by_user(lambda: D.eddm(least=5), True), "ewma_by_user": _by_user(D.ewma, True),
    "page_hinkley_by_user": _by_user(D.page_hinkley, False), "cusum_by_user": _by_user(D.cusum, False), "gma_by_user": _by_user(D.geometric, False),
    "gk_quantiles_by_user": lambda spark, d: summarised(read(spark, d, "events"), "user_id", "event_id", "value"),
    "ph_test_by_user": _by_user(D.ph_test, False), "ph_fading_by_user": _by_user(lambda: D.ph_test(fade=0.99), False), "adwin_by_user": _by_user(D.adwin, False),
}

_LIMIT = "(3.97 + p*(-6.56 + p*p*(48.73 + p*p*(-330.13 + p*p*848.18))))"
SQL = {
    "ddm_by_user": _sql(ERROR, {"n": "1", "p": "1", "pmin": BIG, "smin": BIG, "best": BIG}, [{"p": "p + (x-p)/n"}, {"s": "sqrt(p*(1-p)/n)", "n": "n+1"}, {"low": "(n >= 30 and p+s <= best)::int"}, {"pmin": "case when low=1 then p else pmin end", "smin": "case when low=1 then s else smin end", "best": "case when low=1 then p+s else best end"}], "n > 30 and p+s > pmin + 3*smin", "n >= 30 and p+s > pmin + 2*smin", "p"),
    "eddm_by_user": _sql(ERROR, {"n": "1", "errors": "0", "last": "0", "mean": "0", "squares": "0", "top": "0"}, [{"n": "n+1"}, {"gap": "n-1-last", "errors": "errors + x", "before": "mean"}, {"mean": "case when x > 0 then mean + (gap-mean)/errors else mean end", "last": "case when x > 0 then n-1 else last end"}, {"squares": "case when x > 0 then squares + (gap-mean)*(gap-before) else squares end"}, {"high": "case when x > 0 then mean + 2*sqrt(squares/errors) end"}, {"up": "(x > 0 and high > top)::int"}, {"top": "case when up=1 and n > 30 then high else top end"}], "x > 0 and up = 0 and n > 30 and errors > 5 and high/top < 0.9", "x > 0 and up = 0 and n > 30 and errors > 5 and high/top < 0.95", "mean"),
    "ewma_by_user": _sql(ERROR, {"n": "1", "total": "0", "z": "0", "lft": "1"}, [{"total": "total + x", "lft": "lft*((1-0.2::double)*(1-0.2::double))", "z": "z + 0.2::double*(x-z)"}, {"p": "total/n", "n": "n+1"}, {"s": "sqrt(p*(1-p)*0.2::double*(1-lft)/(2-0.2::double))"}], f"n >= 30 and z > p + {_LIMIT}*s", f"n >= 30 and z > p + 0.5*{_LIMIT}*s", "p"),
    "page_hinkley_by_user": _mean_sum(VALUE, "0.9999::double*total + (x-mean-0.005)", "50"), "cusum_by_user": _mean_sum(VALUE, "greatest(0, total + x - mean - 0.005)", "50"), "gma_by_user": _mean_sum(VALUE, "0.99::double*total + (1-0.99::double)*(x-mean)", "1"),
    "ph_test_by_user": _ph(VALUE, 1.0), "ph_fading_by_user": _ph(VALUE, 0.99), "adwin_by_user": _adwin(VALUE),
}
