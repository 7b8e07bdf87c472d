"""Queries on topologies, files, streams, row-by-row learners and weighted statistics, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import flows
from tidemark.functions import scalars as X
from tidemark.operators import clustering as C
from tidemark.operators import drift as D
from tidemark.operators import evaluation as E
from tidemark.operators import observers as O
from tidemark.operators import online as L
from tidemark.operators import statistics as S
from tidemark.operators.rules import Perceptron
from tidemark.sources import arff, arff_source
from tidemark.sources import generators as G
from tidemark.storage import kept, removed, shared_folder
from tidemark.streaming import stateful, typed

from . import drift as drift_plans
from .clusters import FOUND, TALL, _clusters, found, points
from .streams import MAJORITY, MEASURES, _CURVE, events, learning_curve, read, rounded
from .trees import _MD5, _size


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def round_robin_places(spark, d):
    return flows.in_turn(events(spark, d), "idx", 4).groupBy("place").agg(F.count("*").alias("n"), F.sum("idx").alias("ids"))


def paced_batches(spark, d):
    return flows.paced(events(spark, d), "idx", 200, 0.5).groupBy("batch").agg(F.count("*").alias("n"), F.max("sent").alias("sent"))


def flagged_prequential(spark, d):
    """Every row trains; after a warm-up of 100 rows every third is tested."""
    rows = E.majority(flows.flagged(events(spark, d), "idx", 3, 100), "idx", "y", 5).where("testing")
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.count(F.when(F.col("pred") == F.col("y"), 1)).alias("hits"))


def hello_world(spark, d):
    out = flows.hello_world(_size(spark, d), 3).stream(spark, "shouted")
    return out.groupBy((F.col("value") % 10).alias("last")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("text").alias("text"))


def prob_round(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("idx"), "value")
    return rows.select("idx", X.prob_round(F.col("value"), X.hash_uniform(F.col("idx").cast("string"), F.lit("round"))).alias("rounded"))


def max_inclusion(spark, d):
    return C.max_inclusion(points(spark, d), found(spark, d)).select("id", "inclusion")


def weighted_gaussian(spark, d):
    """Weighted moments of two parts of the rows, merged."""
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_tax").alias("x"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") % 2).alias("part"))
    out = S.merged_gaussian(S.weighted_gaussian(rows, ["l_returnflag", "part"], "x", "w"), ["l_returnflag"])
    return rounded(out.select("l_returnflag", "weight", "mean", "variance"), 8, "weight", "mean", "variance")


def spheres_joined(spark, d):
    """The sphere around two classes' spheres, for each pair of neighbouring labels."""
    c = C.clusters_of(points(spark, d), "label")
    other = c.select((F.col("cluster") - 1).alias("cluster"), F.col("centre").alias("c2"), F.col("radius").alias("r2"), F.col("weight").alias("w2"))
    out = c.join(other, "cluster")
    centre, radius, weight = C.combined(*(F.col(x) for x in ("centre", "radius", "weight", "c2", "r2", "w2")))
    return rounded(out.select("cluster", centre[0].alias("x"), radius.alias("radius"), weight.alias("weight")), 5, "x", "radius", "weight")


def _items(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", F.col("l_returnflag").alias("l_returnflag", metadata={"labels": ["A", "N", "R"]}), F.col("l_linestatus").alias("l_linestatus", metadata={"labels": ["F", "O"]}))


_TOTALS = lambda df: df.na.fill("?", ["l_returnflag"]).groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 4).alias("discount"), F.max("l_quantity").alias("most"), F.count("l_orderkey").alias("keys"), F.sum("bad_labels").cast("long").alias("bad"))


def arff_dense(spark, d):
    """Written as several ARFF files, and read back from the directory; every hundredth key is missing."""
    folder = _folder(spark, "dense")
    arff.write(_items(spark, d).withColumn("l_orderkey", F.when(F.col("l_orderkey") % 100 != 0, F.col("l_orderkey"))), folder)
    return _TOTALS(arff.read(spark, folder, glob="*.txt"))


def _written(spark, d, name):
    folder = _folder(spark, name)
    arff.write(_items(spark, d).withColumn("l_orderkey", F.when(F.col("l_orderkey") % 100 != 0, F.col("l_orderkey"))), f"{folder}/in")
    arff_source.register(spark)
    return folder


def _source_totals(rows, folder, name):
    out = kept(_TOTALS(rows.withColumn("bad_labels", F.col("_problem").isNotNull().cast("int"))), name)
    removed(out.sparkSession, folder)
    return out


def arff_as_source(spark, d):
    """The same files by Spark's reader, in ranges of a megabyte."""
    folder = _written(spark, d, "source")
    return _source_totals(spark.read.format("arff").option("range_bytes", 1 << 20).load(f"{folder}/in"), folder, "source-result")


def arff_as_stream(spark, d):
    """The same files as a stream, appended as Parquet."""
    folder = _written(spark, d, "stream")
    rows = spark.readStream.format("arff").load(f"{folder}/in")
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _source_totals(spark.read.parquet(f"{folder}/rows"), folder, "stream-result")


def arff_sparse(spark, d):
    """Sparse rows: zeros and first labels are left out; the label X is not in the header."""
    folder = _folder(spark, "sparse")
    rows = _items(spark, d)
    said = lambda k, c, skip: F.when(c != skip, F.concat(F.lit(f"{k} "), c.cast("string")))
    flag = F.when(F.col("l_orderkey") % 500 == 0, "X").otherwise(F.col("l_returnflag"))
    row = F.concat(F.lit("{"), F.concat_ws(", ", said(0, F.col("l_orderkey"), 0), said(1, F.col("l_quantity"), 0), said(2, F.col("l_discount"), 0), said(3, flag, "A"), said(4, F.col("l_linestatus"), "F")), F.lit("}"))
    head = spark.createDataFrame([(line,) for line in arff.to_arff(rows, "sparse").split("\n")], "value string").coalesce(1)
    head.write.text(f"{folder}/a")
    rows.select(row.alias("value")).write.text(f"{folder}/b")
    return _TOTALS(arff.read(spark, f"{folder}/*", glob="*.txt"))


def curve_dump(spark, d):
    folder = _folder(spark, "curve")
    stateful.dump_curve(learning_curve(spark, d), folder, {"n": "evaluation instances"})
    back = spark.read.option("header", True).csv(folder)
    return back.select(F.col("evaluation instances").cast("long").alias("n"), *(F.col(m).try_cast("double").alias(m) for m in MEASURES))


def _streamed(spark, d, name, made):
    """Events as a stream of PARTS micro-batches in the order of their ids, with typed state; the rows that it gives.

    A part is written by as many tasks as its rows need, dealt by user: a user's rows of a part lie in one file, and parts follow
    one another, so that its rows come in order whatever files make up a micro-batch.
    """
    folder = _folder(spark, name)
    rows = read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").cast("double").alias("x"), F.col("event_type").alias("y"), F.lit("view").alias("pred"))
    last, n = rows.agg(F.max("event_id"), F.count("*")).first()
    cuts, files = [-(-k * (last + 1) // PARTS) for k in range(PARTS + 1)], 1 + n // (PARTS * FILE)
    for low, high in zip(cuts, cuts[1:]):
        rows.where((F.col("event_id") >= low) & (F.col("event_id") < high)).repartition(files, "user_id").write.mode("append").parquet(f"{folder}/in")
    with typed.rocksdb(spark):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        made(stream).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows"), folder


#: Micro-batches of a stream, and rows aimed at in a file.
PARTS, FILE = 3, 500_000


def _stream_detect(name, detector):
    def query(spark, d):
        out, folder = _streamed(spark, d, name, lambda s: typed.detect(s, "user_id", "event_id", "x", detector()))
        got = D.summary(out.where("not late"), "user_id", "event_id")
        got = kept(rounded(got.withColumn("estimate", F.col("estimate") + drift_plans.NUDGE), 4, "estimate"), f"{name}-result")
        removed(spark, folder)
        return got

    return query


def stream_accuracy(spark, d):
    """Accuracy over the last 20 rows of each user, as a stream; the prediction is the most usual class."""
    out, folder = _streamed(spark, d, "accuracy", lambda s: typed.windowed_accuracy(s, "user_id", "event_id", "y", "pred", 20))
    got = out.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("accuracy", "event_id").alias("accuracy"), F.count(F.when(F.col("late"), 1)).alias("late"))
    got = kept(rounded(got, 6, "accuracy"), "accuracy-result")
    removed(spark, folder)
    return got


def _keyed(spark, d):
    """Orders dealt to sixteen keys; the class follows price and month, but for one in twenty."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 500000).alias("att1"), (F.month("o_orderdate") / 12).alias("att2"), ((F.col("o_custkey") % 97) / 97).alias("att3"), (F.dayofmonth("o_orderdate") / 31).alias("att4"))
    return rows.withColumns({"key": F.pmod("idx", F.lit(16)), "y": ((F.col("att1") + F.col("att2") > 1) != (F.col("idx") % 20 == 0)).cast("int")})


X4 = [f"att{k}" for k in range(1, 5)]


def _online(make, classes=2):
    return lambda spark, d: L.hits(L.prequential_by(_keyed(spark, d), "key", "idx", X4, "y", make, classes), "key", "y")


def online_majority(spark, d):
    return L.hits(L.prequential_by(events(spark, d), "user_id", "idx", ["value"], "y", lambda: L.Majority(5), 5), "user_id", "y")


def online_bagging(spark, d):
    """Bagged majority classes: each learner's weights by row and learner."""
    return L.hits(L.prequential_by(events(spark, d), "user_id", "idx", ["value"], "y", lambda: L.Bagging(lambda: L.Majority(5), 3, 5), 5), "user_id", "y")


def vfml_bins_by_user(spark, d):
    """Ten bins a user, opened by the first distinct values: rows, and rows of class 1, on either side of each cut."""
    out = O.observed_cuts(events(spark, d), "user_id", "idx", "value", "y", lambda: O.Bins(5))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return out.select("user_id", "cut", total("below").alias("below"), total("above").alias("above"), F.get("below", 1).alias("errors"))


def limited_moments_by_user(spark, d):
    """Moments of a target at or below each of a user's first ten distinct values, and beyond."""
    rows = events(spark, d).withColumn("target", (F.col("idx") % 24).cast("double"))
    out = O.observed_cuts(rows, "user_id", "idx", "value", "target", lambda: O.LimitedMoments(10))
    return out.select("user_id", "cut", F.get("below", 0).alias("n"), F.get("below", 1).alias("s"), F.get("below", 2).alias("q"), F.get("above", 1).alias("rest"))


def online_rules(spark, d):
    rows = _keyed(spark, d).withColumn("target", 10 * F.col("att1") + F.when(F.col("att2") > 0.5, 5.0).otherwise(0.0))
    out = L.prequential_by(rows, "key", "idx", X4, "target", lambda: L.Rules(X4))
    return rounded(out.groupBy("key").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae")), 6, "mae")


QUERIES = {
    "round_robin_places": round_robin_places, "paced_batches": paced_batches, "flagged_prequential": flagged_prequential, "hello_world": hello_world, "prob_round": prob_round,
    "max_inclusion": max_inclusion, "weighted_gaussian": weighted_gaussian, "spheres_joined": spheres_joined, "arff_dense": arff_dense, "arff_sparse": arff_sparse, "arff_as_source": arff_as_source, "arff_as_stream": arff_as_stream, "curve_dump": curve_dump,
    "stream_ddm_by_user": _stream_detect("ddm", D.ddm), "stream_adwin_by_user": _stream_detect("adwin", D.adwin), "stream_accuracy_by_user": stream_accuracy, "vfml_bins_by_user": vfml_bins_by_user, "limited_moments_by_user": limited_moments_by_user, "online_majority_by_user": online_majority, "online_bagging_by_user": online_bagging,
    "online_tree": _online(lambda: L.Tree(2, grace=50, tie=0.2)), "online_bayes": _online(lambda: L.NaiveBayes(2)), "online_adaptive_tree": _online(lambda: L.Adaptive(lambda: L.Tree(2, grace=50, tie=0.2), D.ddm())),
    "online_bagged_trees": _online(lambda: L.Bagging(lambda: L.Tree(2, grace=50, tie=0.2), 3, 2)), "online_boosted_bayes": _online(lambda: L.Boosting(lambda: L.NaiveBayes(2), 3, 2)), "online_rules": online_rules,
}

_ITEMS = "select l_linestatus, {flag} as l_returnflag, count(*) as n, round(sum(l_discount),4) as discount, max(l_quantity) as most, count({key}) as keys, sum({bad})::bigint as bad from lineitem group by 1,2"
_IDX = "i as (select range as idx from range((select count(*) from events)))"
_U = lambda name, seed=1: _MD5(f"'{seed}'", "idx::varchar", f"'{name}'")


def _tree_sql(tree) -> str:
    if tree[0] == "class":
        return f"'{tree[1]}'"
    if tree[0] == "numeric":
        return f"case when {tree[1]} < {tree[2]!r} then {_tree_sql(tree[3])} else {_tree_sql(tree[4])} end"
    return "case " + " ".join(f"when {tree[1]} = '{v}' then {_tree_sql(c)}" for v, c in tree[2].items()) + " end"


_NOMINAL = ", ".join(f"'value' || (floor({_U(f'n{k}')}*5)::int + 1) as nominal{k + 1}" for k in range(5))
_NUMERIC = ", ".join(f"{_U(f'x{k}')} as numeric{k + 1}" for k in range(5))
_RBF = G.RandomRBF(events=True, every=300)
_PHASE = f"(floor(idx/{float(_RBF.every)!r})::bigint % {4 * _RBF.span})"
_ACTIVE = f"({_RBF.k} + case when {_PHASE} <= {_RBF.span} then {_PHASE} when {_PHASE} <= {3 * _RBF.span} then {2 * _RBF.span} - {_PHASE} else {_PHASE} - {4 * _RBF.span} end)::int"


def _place_sql(j: int, k: str) -> str:
    """A sphere's place on one axis: it goes to and fro between the walls."""
    low, width = _RBF.radius, 1 - 2 * _RBF.radius
    axis = lambda rows: "[" + ", ".join(repr(float(r[j])) for r in rows) + "]"
    way = f"({axis(_RBF.starts)}[{k}+1] - {low!r} + {axis(_RBF.ways)}[{k}+1]*{_RBF.step!r}*floor(idx/{float(_RBF.speed)!r}))"
    rest = f"({way} - {2 * width!r}*floor({way}/{2 * width!r}))"
    return f"({low!r} + case when {rest} <= {width!r} then {rest} else {2 * width!r} - {rest} end)"


_GAUSS = ", ".join(f"sqrt(-2*ln(1-{_U(f'g{j}')}))*cos(6.283185307179586*{_U(f'h{j}')}) as g{j}" for j in range(2))
_PERCEPTRON_START = Perceptron(2).w.tolist()
#: One row a step: standardised inputs and target, the delta rule with a decaying rate, weights kept within their number.
_PERCEPTRON = f"""with recursive o as (select user_id, row_number() over (partition by user_id order by event_id) as rn, (list_position(['click','error','purchase','signup','view'], event_type)-1)::double as a, (event_id % 24)::double as b, value as y from events),
 st as (select user_id, 0::bigint as rn, {", ".join(f"{w!r}::double as w{k}" for k, w in enumerate(_PERCEPTRON_START))}, 0::double as n, 0::double as a1, 0::double as a2, 0::double as b1, 0::double as b2, 0::double as y1, 0::double as y2, 0::double as e, 0::double as seen from (select distinct user_id from o)
 union all select user_id, rn, case when size > 2 then v0/size else v0 end, case when size > 2 then v1/size else v1 end, case when size > 2 then v2/size else v2 end, n, a1, a2, b1, b2, y1, y2, e, seen from (
  select *, abs(v0)+abs(v1)+abs(v2) as size0, case when ysd > 1e-7 then abs(v0)+abs(v1)+abs(v2) else 0 end as size from (
   select *, case when ysd > 1e-7 then w0 + move else w0 end as v0, case when ysd > 1e-7 then w1 + move*za else w1 end as v1, case when ysd > 1e-7 then w2 + move*zb else w2 end as v2 from (
    select *, case when ysd > 1e-7 then 0.025/(1+n*0.001)*((y-ym)/ysd - (w0 + w1*za + w2*zb)) end as move from (
     select *, case when asd > 1e-7 then (a-am)/asd else 0 end as za, case when bsd > 1e-7 then (b-bm)/bsd else 0 end as zb from (
      select *, a1/n as am, sqrt(greatest((a2-a1*(a1/n))/greatest(n-1,1),0)) as asd, b1/n as bm, sqrt(greatest((b2-b1*(b1/n))/greatest(n-1,1),0)) as bsd, y1/n as ym, sqrt(greatest((y2-y1*(y1/n))/greatest(n-1,1),0)) as ysd from (
       select user_id, rn, w0, w1, w2, n+1 as n, a1+a as a1, a2+a*a as a2, b1+b as b1, b2+b*b as b2, y1+y as y1, y2+y*y as y2, abs(pred-y) + 0.99*e as e, 1+0.99*seen as seen, a, b, y from (
        select *, (w0 + w1*case when asd > 1e-7 then (a-am)/asd else 0 end + w2*case when bsd > 1e-7 then (b-bm)/bsd else 0 end)*ysd + ym as pred from (
         select st.user_id, o.rn, w0, w1, w2, n, a1, a2, b1, b2, y1, y2, e, seen, o.a, o.b, o.y, a1/greatest(n,1) as am, sqrt(greatest((a2-a1*(a1/greatest(n,1)))/greatest(n-1,1),0)) as asd, b1/greatest(n,1) as bm, sqrt(greatest((b2-b1*(b1/greatest(n,1)))/greatest(n-1,1),0)) as bsd, y1/greatest(n,1) as ym, sqrt(greatest((y2-y1*(y1/greatest(n,1)))/greatest(n-1,1),0)) as ysd
         from st join o on o.user_id = st.user_id and o.rn = st.rn + 1))))))))"""
#: Summaries of at most ten tuples: insert, then join the least full pair whose first is no surer than its second.
_GK = """with recursive o as (select user_id, row_number() over (partition by user_id order by event_id) as rn, value as x from events),
 st as (select user_id, 0::bigint as rn, []::struct(v double, g bigint, d bigint)[] as t from (select distinct user_id from o)
 union all select user_id, rn, case when j is null then u else u[:j-1] || [struct_pack(v := u[j+1].v, g := u[j].g + u[j+1].g, d := u[j+1].d)] || u[j+2:] end from (
  select *, case when len(u) >= 10 then coalesce(list_min([case when u[i].d >= u[i+1].d then (u[i].g + u[i+1].g + u[i+1].d)*1000 + i end for i in range(2, len(u))]), case when len(u) > 10 then list_min([(u[i].g + u[i+1].g + u[i+1].d)*1000 + i for i in range(2, len(u))]) end) % 1000 end as j from (
   select user_id, rn, t[:k] || [struct_pack(v := x, g := 1::bigint, d := case when k < len(t) then t[k+1].g + t[k+1].d - 1 else 0 end::bigint)] || t[k+1:] as u from (
    select st.user_id, o.rn, o.x, st.t, len(list_filter(st.t, lambda e: e.v <= o.x)) as k from st join o on o.user_id = st.user_id and o.rn = st.rn + 1)))),
 last as (select user_id, max(rn) as n, arg_max(t, rn) as t from st group by 1),
 ranks as (select user_id, n, t, [list_sum([e.g for e in t[:i]])::bigint for i in range(1, len(t)+1)] as r from last)
 select user_id, n, """ + ", ".join(f"coalesce(t[list_min([case when r[i] + t[i+1].g > ceil({q}*n) then i end for i in range(1, len(t))])].v, t[-1].v) as {name}" for q, name in ((0.25, "lower"), (0.5, "median"), (0.75, "upper"))) + " from ranks"
#: The first ten distinct values of each user, which are the cut points of both limited observers.
_POINTS = "e as (select user_id, event_id as idx, value as x, list_position(['click','error','purchase','signup','view'], event_type)-1 as y, (event_id % 24)::double as t from events), f as (select user_id, x as p, row_number() over (partition by user_id order by min(idx)) as k from e group by 1,2), pts as (select user_id, p, min(p) over (partition by user_id) as p0 from f where k <= 10)"
_BEFORE = "rows between unbounded preceding and 1 preceding"
_DRAWN = ", ".join(f"{X.poisson1_sql(_MD5('(rn-1)::varchar', f'{chr(39)}{m}{chr(39)}'))} as k{m}" for m in range(3))
_KEPT = ", ".join(f"coalesce(sum(k{m}*(y={c})::int) over w, 0)::double as c{m}{c}" for m in range(3) for c in range(5))
_VOTED = ", ".join("0.0::double + " + " + ".join(f"case when {'+'.join(f'c{m}{j}' for j in range(5))} > 0 then c{m}{c}/({'+'.join(f'c{m}{j}' for j in range(5))}) else 0 end" for m in range(3)) + f" as v{c}" for c in range(5))
_BAGGED = f"with e as (select user_id, row_number() over (partition by user_id order by event_id) as rn, list_position(['click','error','purchase','signup','view'], event_type)-1 as y from events), k as (select *, {_DRAWN} from e), s as (select user_id, y, {_KEPT} from k window w as (partition by user_id order by rn {_BEFORE})), v as (select user_id, y, {_VOTED} from s), p as (select *, case " + " ".join(f"when v{c}=greatest(v0,v1,v2,v3,v4) then {c}" for c in range(5)) + " end as pred from v) select user_id, count(*) as n, count(*) filter (pred=y) as hits from p group by 1"
_SUMS = ", ".join(f"coalesce(sum(case when y={c} then {v} else 0 end) over w, 0)::double as {name}" for c in range(2) for v, name in [("1", f"n{c}"), *((f"a{j}", f"s{c}{j}") for j in range(4)), *((f"a{j}*a{j}", f"q{c}{j}") for j in range(4))])
_DENSITY = lambda c, j: f"case when n{c} > 1 and q{c}{j}-s{c}{j}*s{c}{j}/n{c} > 0 then exp(-power(a{j}-s{c}{j}/n{c},2)/(2*(q{c}{j}-s{c}{j}*s{c}{j}/n{c})/(n{c}-1)))/sqrt(2*pi()*(q{c}{j}-s{c}{j}*s{c}{j}/n{c})/(n{c}-1)) else (a{j}=s{c}{j}/n{c})::int end"
_VOTE = lambda c: f"case when n{c} > 0 then n{c}/(n0+n1)*" + "*".join(f"({_DENSITY(c, j)})" for j in range(4)) + " else 0 end"
_BAYES = f"with a as (select o_orderkey as idx, o_totalprice/500000 as a0, month(o_orderdate)/12 as a1, (o_custkey%97)/97 as a2, day(o_orderdate)/31 as a3 from orders), b as (select *, ((a0+a1 > 1) <> (idx % 20 = 0))::int as y, idx % 16 as key from a), s as (select *, {_SUMS} from b window w as (partition by key order by idx {_BEFORE})), v as (select key, y, {_VOTE(0)} as v0, {_VOTE(1)} as v1 from s) select key, count(*) as n, count(*) filter (y = (v1 > v0)::int) as hits from v group by 1"
_M, _K = range(5), range(5)


def _boosting_sql() -> str:
    """One row a step: the votes, then each model's rate from the one before, then the counts by Poisson draws."""
    count = lambda m: [f"c{m}{c}" for c in _K]
    total = lambda m: "(" + "+".join(count(m)) + ")"
    state = [*(x for m in _M for x in count(m)), *(f"{x}{m}" for m in _M for x in ("r", "w", "s"))]
    weight = lambda m: f"case when r{m}+w{m} > 0 and w{m} > 0 and w{m}/(r{m}+w{m}) <= 0.5 then ln((1-w{m}/(r{m}+w{m}))/(w{m}/(r{m}+w{m}))) else 0 end"
    first = lambda names: "case " + " ".join(f"when {n}=greatest({','.join(names)}) then {k}" for k, n in enumerate(names)) + " end"
    votes = ", ".join("0.0::double + " + " + ".join(f"case when {total(m)} > 0 then g{m}*c{m}{c}/{total(m)} else 0 end" for m in _M) + f" as v{c}" for c in _K)
    body = f"select st.*, o.y, {', '.join(f'o.u{m}' for m in _M)}, {', '.join(f'{weight(m)} as g{m}' for m in _M)}, {', '.join(f'({first(count(m))}) = o.y as h{m}' for m in _M)}, 1.0::double as rate0 from st join o on o.user_id = st.user_id and o.rn = st.rn + 1"
    body = f"select *, {votes} from ({body})"
    for m in _M:
        body = f"select *, rate{m}*(s{m}+rate{m})/(2*case when h{m} then r{m}+rate{m} else w{m}+rate{m} end) as rate{m + 1} from ({body})"
    drawn = lambda m: f"len(list_filter(range(0, 46), lambda j: list_sum([exp(-rate{m} + i*ln(rate{m}) - lgamma(i+1)) for i in range(0, j+1)]) <= u{m}))"
    body = f"select *, {', '.join(f'{drawn(m)} as t{m}' for m in _M)} from ({body})"
    new = [*(f"c{m}{c} + (y={c})::int*t{m}" for m in _M for c in _K), *(x for m in _M for x in (f"r{m} + h{m}::int*rate{m}", f"w{m} + (not h{m})::int*rate{m}", f"s{m} + rate{m}"))]
    start = ", ".join(f"0::double as {x}" for x in state)
    uniform = ", ".join(f"{_MD5('event_id::varchar', f'{chr(39)}{m}{chr(39)}')} as u{m}" for m in _M)
    return f"""with recursive o as (select user_id, row_number() over (partition by user_id order by event_id) as rn, list_position(['click','error','purchase','signup','view'], event_type)-1 as y, {uniform} from events),
 st as (select user_id, 0::bigint as rn, 0::bigint as hits, {start} from (select distinct user_id from o) union all
 select user_id, rn + 1, hits + ({first([f"v{c}" for c in _K])} = y)::int, {', '.join(new)} from ({body}))
 select user_id, max(rn) as n, max(hits) as hits from st group by 1"""


_C = ",".join(f"c{c}" for c in _K)
_T = _C.replace(",", "+")
_TOP = "case " + " ".join(f"when c{c}=greatest({_C}) then {c}" for c in _K) + " end"
_SHARED = ", ".join("0.0::double + " + " + ".join(f"coalesce(max(case when st.m={m} and t > 0 then c{c}/t end),0)" for m in _M) + f" as v{c}" for c in _K)
#: One row a step for each user and model: the detector moves on the model's misses, and a rise of its estimate starts the model anew.
_ADAPTIVE = f"""with recursive e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as rn, list_position(['click','error','purchase','signup','view'], event_type)-1 as y from events),
 o as (select user_id, rn, y, m, {X.poisson1_sql(_MD5('event_id::varchar', 'm::varchar'))} as k from e, range(5) r(m)),
 st as (select user_id, m, 0::bigint as rn, {", ".join(f"0::double as c{c}" for c in _K)}, 1::double as n, 1::double as p, 1e300::double as pm, 1e300::double as sm, 1e300::double as best, 0::double as est, 0::bigint as resets from (select distinct user_id, m from o) union all
 select user_id, m, rn+1, {", ".join(f"case when anew then 0 else c{c} + (y={c})::int*k end" for c in _K)}, case when anew then 1 else n+1 end, case when anew then 1 else p2 end, case when anew then 1e300 else pm2 end, case when anew then 1e300 else sm2 end, case when anew then 1e300 else best2 end, case when anew then 0 else p2 end, resets + anew::int from (
  select *, n+1 > 30 and p2+s2 > pm2+3*sm2 and p2 > est as anew from (
   select *, case when low then p2 else pm end as pm2, case when low then s2 else sm end as sm2, case when low then p2+s2 else best end as best2 from (
    select *, n+1 >= 30 and p2+s2 <= best as low from (select *, sqrt(greatest(p2*(1-p2),0)/n) as s2 from (
     select st.*, o.y, o.k, p + ((({_TOP}) <> o.y)::int - p)/n as p2 from st join o on o.user_id = st.user_id and o.m = st.m and o.rn = st.rn + 1)))))),
 v as (select st.user_id, o.rn, o.y, {_SHARED} from (select *, {_T} as t from st) st join o on o.user_id = st.user_id and o.m = st.m and o.rn = st.rn + 1 group by 1,2,3),
 h as (select user_id, count(*) as n, count(*) filter (y = case {" ".join(f"when v{c}=greatest(v0,v1,v2,v3,v4) then {c}" for c in _K)} end) as hits from v group by 1),
 z as (select user_id, sum(resets)::int as resets from (select user_id, m, max(resets) as resets from st group by 1,2) group by 1)
 select user_id, n, hits, resets from h join z using (user_id)"""


SQL = {
    "round_robin_places": "select place, count(*) as n, sum(event_id)::bigint as ids from (select event_id, ((row_number() over (order by event_id)-1) % 4)::int as place from events) group by 1",
    "paced_batches": "select batch, count(*) as n, batch*0.5::double as sent from (select ((row_number() over (order by event_id)-1)//200)::bigint as batch from events) group by 1",
    "flagged_prequential": f"with {MAJORITY}, r as (select *, row_number() over (order by idx)-1 as rn from predicted) select y::int as y, count(*) as n, count(*) filter (pred=y) as hits from r where rn >= 100 and (rn-100) % 3 = 0 group by 1",
    "hello_world": f"with {_IDX}, v as (select floor({_U('hello')}*1000)::bigint as value from i) select value % 10 as last, count(*) as n, sum(value)::bigint as total, max('HELLO ' || value) as text from v group by 1",
    "prob_round": f"select event_id as idx, (floor(value) + (value - floor(value) > {_MD5('event_id::varchar', chr(39) + 'round' + chr(39))})::int)::bigint as rounded from events",
    "max_inclusion": f"with {FOUND} select p.id, (count(held.id) > 0)::int::double as inclusion from (select distinct id from tall) p left join held on held.id=p.id group by 1",
    "weighted_gaussian": "select l_returnflag, round(sum(l_quantity),8) as weight, round(sum(l_quantity*l_tax)/sum(l_quantity),8) as mean, round((sum(l_quantity*l_tax*l_tax)-sum(l_quantity*l_tax)*sum(l_quantity*l_tax)/sum(l_quantity))/(sum(l_quantity)-1),8) as variance from lineitem group by 1",
    "spheres_joined": f"with {TALL}, {_clusters('label', 'c')}, d as (select a.cluster, a.n as n1, b.n as n2, sqrt(sum((a.ls/a.n-b.ls/b.n)*(a.ls/a.n-b.ls/b.n))) as d, max((a.ls+b.ls)/(a.n+b.n)) filter (a.i = 0) as x from c_cf a join c_cf b on a.i=b.i and a.cluster+1 = b.cluster group by 1,2,3) select d.cluster::int as cluster, round(x,5) as x, round(greatest(c1.radius, c2.radius, (c1.radius+c2.radius+d)/2),5) as radius, n1+n2 as weight from d join c c1 using (cluster) join c c2 on c2.cluster=d.cluster+1",
    "arff_dense": _ITEMS.format(flag="l_returnflag", key="case when l_orderkey % 100 <> 0 then 1 end", bad="0"),
    "arff_sparse": _ITEMS.format(flag="case when l_orderkey % 500 <> 0 then l_returnflag else '?' end", key="*", bad="(l_orderkey % 500 = 0)::int"),
    "curve_dump": _CURVE + " select * from curve",
    "stream_ddm_by_user": drift_plans.SQL["ddm_by_user"], "stream_adwin_by_user": drift_plans._adwin(drift_plans.ERROR),
    "stream_accuracy_by_user": "with h as (select user_id, event_id, avg((event_type='view')::int) over (partition by user_id order by event_id rows between 19 preceding and current row) as a from events) select user_id, count(*) as n, round(arg_max(a, event_id),6)+0.0 as accuracy, 0::bigint as late from h group by 1",
    "online_majority_by_user": "with e as (select user_id, event_id, list_position(['click','error','purchase','signup','view'], event_type)-1 as y from events), s as (select *, " + ", ".join(f"coalesce(sum((y={c})::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding),0) as s{c}" for c in range(5)) + " from e), p as (select *, case " + " ".join(f"when s{c}=greatest(s0,s1,s2,s3,s4) then {c}" for c in range(5)) + " end as pred from s) select user_id, count(*) as n, count(*) filter (pred=y) as hits from p group by 1",
    "vfml_bins_by_user": f"with {_POINTS}, m as (select user_id, max(x) as most from e group by 1) select pts.user_id, p as cut, count(*) filter (x = p or x < p and p > p0)::double as below, count(*) filter (not (x = p or x < p and p > p0))::double as above, count(*) filter ((x = p or x < p and p > p0) and y = 1)::double as errors from pts join e using (user_id) join m using (user_id) where p < most group by 1, 2",
    "limited_moments_by_user": f"with {_POINTS} select pts.user_id, p as cut, count(*) filter (x <= p)::double as n, coalesce(sum(t) filter (x <= p),0) as s, coalesce(sum(t*t) filter (x <= p),0) as q, coalesce(sum(t) filter (x > p),0) as rest from pts join e using (user_id) group by 1, 2",
    "online_bagging_by_user": _BAGGED,
    "online_bayes": _BAYES,
    "stream_random_tree": f"with {_IDX}, r as (select idx, {_NOMINAL}, {_NUMERIC} from i), c as (select nominal1, {_tree_sql(G.tree_of())} as class from r) select nominal1, class, count(*) as n from c group by 1,2",
    "stream_rbf": f"with {_IDX}, r as (select idx, {_U('noise')} < {_RBF.noise!r} as noise, floor({_U('which')}*{_ACTIVE})::int as k, power({_U('r')}, 0.5)*{_RBF.radius!r} as r, {_GAUSS}, {_U('u0')} as u0 from i) select case when noise then {_RBF.most} else k end as class, count(*) as n, round(avg(case when noise then u0 else {_place_sql(0, 'k')} + r*g0/sqrt(g0*g0+g1*g1) end),6) as mean from r group by 1",
    "stream_rbf_truth": f"with t as (select range as idx from range(0, (select count(*) from events), 1000)), c as (select idx, unnest(range({_ACTIVE})) as cluster from t) select idx, cluster::int as cluster, round({_place_sql(0, 'cluster')},6) as x, {_RBF.radius!r}::double as radius from c",
    "stream_rbf_changes": f"with i as (select range as idx from range({_RBF.every}, greatest((select count(*) from events), {_RBF.every}), {_RBF.every})), a as (select idx, {_ACTIVE} as now, {_ACTIVE.replace('idx', '(idx-1)')} as was from i) select idx, case when now > was then 'create' else 'delete' end as type, now || ' clusters' as message from a where now <> was",
    "perceptron_by_user": _PERCEPTRON + ") select user_id, max(rn) as n, round(arg_max(e/seen, rn),4) as error from st where rn > 0 group by 1",
    "boosting_by_user": _boosting_sql(),
    "adaptive_bagging_by_user": _ADAPTIVE,
    "gk_quantiles_by_user": _GK,
}
SQL |= {"arff_as_source": SQL["arff_dense"], "arff_as_stream": SQL["arff_dense"]}
