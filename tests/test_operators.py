import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry, tasks
from tidemark.functions import scalars as X
from tidemark.operators import clustering as C
from tidemark.operators import drift as D
from tidemark.operators import ensembles as N
from tidemark.operators import evaluation as E
from tidemark.operators import hoeffding as H
from tidemark.operators import micro as M
from tidemark.operators import ordered as O
from tidemark.operators import rules as R
from tidemark.operators import statistics as S
from tidemark.sources import arff
from tidemark.sources import generators as G


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_kappa_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 1)], "idx long, y int, pred int")
    out = E.classification_total(df, "idx", "y", "pred", 2).first()
    assert (out.accuracy, out.kappa, out.kappa_temporal) == (75.0, 50.0, 0.0)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_do_not_matter(spark, block):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(20)], "idx long, v long")
    run = {r.idx: r.s for r in O.running(df, "idx", {"s": F.col("v")}, block=block).collect()}
    slide = {r.idx: r.s for r in O.sliding(df, "idx", 4, {"s": F.col("v")}, block=block).collect()}
    before = {r.idx: r.previous for r in O.previous(df, "idx", "v", -1, block=block).collect()}
    v = [(i * 7) % 5 for i in range(20)]
    assert run == {i: sum(v[: i + 1]) for i in range(20)}
    assert slide == {i: sum(v[max(0, i - 3) : i + 1]) for i in range(20)}
    assert before == {i: v[i - 1] if i else -1 for i in range(20)}


def test_blocks_follow_quantiles_and_keep_null_orders(spark):
    """Clustered and sparse order values give blocks of about as many rows; a null order stands first and is not dropped."""
    rows = [(i if i < 900 else i * 10**9, 1) for i in range(1000)]
    df = spark.createDataFrame([*rows, (None, 5)], "idx long, v long")
    cut = O.blocked(df, "idx", 100)
    sizes = {r._block: r["count"] for r in cut.groupBy("_block").count().collect()}
    assert sizes.pop(-1) == 1 and len(sizes) == 10 and max(sizes.values()) < 130
    out = {r.idx: (r.s, r.rn) for r in O.numbered(O.running(df, "idx", {"s": F.col("v")}, block=100), "idx", 100).collect()}
    assert out[None] == (5, 0) and out[0] == (6, 1) and out[999 * 10**9] == (1005, 1000) and len(out) == 1001
    assert O.previous(df, "idx", "v", -1, 100).where("idx = 0").first().previous == 5
    assert O.running(df.where("false"), "idx", {"s": F.col("v")}).count() == 0


@pytest.mark.parametrize("width", [5, 80])
def test_sliding_sums_of_any_width(spark, width):
    v = [(i * 7919) % 13 for i in range(500)]
    out = O.sliding(spark.createDataFrame(list(enumerate(v)), "idx long, v long"), "idx", width, {"s": F.col("v")}, block=90)
    assert {r.idx: r.s for r in out.collect()} == {i: sum(v[max(0, i - width + 1) : i + 1]) for i in range(500)}


@pytest.mark.parametrize("block", [2, 1000])
def test_latest_truth_at_or_before(spark, block):
    results = [(t, f"r{t}") for t in (5, 100, 130, 150, 151, 350, 351)] + [(None, "none"), (350, "again")]
    truth = [(100, "a"), (150, "b"), (210, "c"), (210, "d"), (None, "never"), (900, "late")]
    out = O.latest(spark.createDataFrame(results, "ts long, name string"), spark.createDataFrame(truth, "ts long, truth string"), "ts", ["truth"], block)
    want = {"r5": None, "r100": "a", "r130": "a", "r150": "b", "r151": "b", "r350": "d", "r351": "d", "none": None, "again": "d"}
    assert {r.name: r.truth for r in out.collect()} == want


@pytest.mark.parametrize("block", [1024, 9])
def test_pairwise_measures_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 3)) + np.repeat([[0, 0, 0], [3, 3, 3]], 20, 0)
    label = [-1 if i % 9 == 0 else i % 2 for i in range(40)]
    points = spark.createDataFrame([(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label))], "id long, x array<double>, label int")
    clusters = [{"cluster": k, "centre": c, "radius": r, "weight": 20.0} for k, c, r in ((4, [0.0] * 3, 2.0), (7, [3.0] * 3, 2.2), (9, [2.0] * 3, 1.5))]
    member = [[c["cluster"] for c in clusters if np.linalg.norm(v - c["centre"]) <= c["radius"]] for v in x]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    scores, pairs = [], []
    for i in range(40):
        pairs += [d[i, j] for j in range(i + 1, 40) for k in member[i] if k in member[j]]
        if member[i]:
            mean = {k: np.mean(near) for k in (4, 7, 9) if (near := [d[i, j] for j in range(40) if j != i and label[j] != -1 and k in member[j]])}
            own = [(v, k) for k, v in mean.items() if k in member[i]]
            rest = [v for k, v in mean.items() if own and k != min(own)[1]]
            if own and rest:
                scores.append((min(rest) - min(own)[0]) / max(min(rest), min(own)[0]))
    assert C.silhouette(points, clusters).first()[0] == pytest.approx((np.mean(scores) + 1) / 2)
    assert C.c_index(points, clusters).first()[0] == pytest.approx((np.mean(pairs) - min(pairs)) / (max(pairs) - min(pairs)))


def test_scalars(spark):
    a = F.array(F.lit(2.0), F.lit(5.0), F.lit(5.0))
    r = one(spark, X.max_index(a), X.min_index(a), X.normalize(a)[0], X.kth_smallest(a, 2), X.entropy(F.array(F.lit(4.0), F.lit(4.0))), X.normal_cdf(F.lit(1.96)), X.normalize(F.array(F.lit(0.0))))
    assert r[0] == 1 and r[1] == 0 and r[2] == pytest.approx(1 / 6) and r[3] == 5 and r[4] == 1
    assert r[5] == pytest.approx(0.975, abs=1e-4) and r[6] is None
    assert list(one(spark, *(X.poisson1(F.lit(u)) for u in (0.3, 0.5, 0.8, 0.95)))) == [0, 1, 2, 3]


def test_gains():
    assert H.info_gain(np.array([4.0, 4]), [np.array([4.0, 0]), np.array([0, 4.0])]) == 1
    assert H.info_gain(np.array([4.0, 4]), [np.array([4.0, 4]), np.array([0.0, 0])]) == -math.inf
    assert H.gini_gain(np.array([4.0, 4]), [np.array([4.0, 0]), np.array([0, 4.0])]) == 1


def test_hoeffding_bound(spark):
    assert one(spark, X.hoeffding_bound(F.lit(1.0), 1e-7, F.lit(200.0)))[0] == pytest.approx(0.20074, abs=1e-5)


def test_observers_ignore_missing_values(spark):
    df = spark.createDataFrame([("a", v) for v in (2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0, None)], "y string, x double")
    r = S.gaussian_observers(df, ["x"], "y").first()
    assert (r.n, r["mean"], r.variance) == (8, 5.0, pytest.approx(32 / 7))


@pytest.mark.parametrize("make", [D.ddm, D.eddm, D.ewma, lambda: D.page_hinkley(bar=25), lambda: D.cusum(bar=25), lambda: D.geometric(bar=0.25), lambda: D.ph_test(bar=25), D.adwin])
def test_detectors_see_a_jump_and_stay_calm_without_one(make):
    rng = np.random.default_rng(0)
    calm = (rng.random(2000) < 0.2).astype(float)
    jump = (rng.random(1000) < 0.8).astype(float)
    before = sum(c for c, _, _ in make().run(calm))
    found = [i for i, (c, _, _) in enumerate(make().run(np.r_[calm, jump])) if c and i >= 2000]
    assert found and before <= 5


def test_adwin_window_follows_the_mean():
    *_, last = D.adwin().run([0.0] * 2000 + [1.0] * 2000)
    assert last[2] > 0.95


def test_batch_equals_streaming(spark, tmp_path):
    from tidemark.streaming import stateful

    rows = [(u, i, float((i * 13 + u) % 7 == 0 or i > 120)) for i in range(200) for u in (1, 2)]
    df = spark.createDataFrame(rows, "user long, idx long, x double")
    for k in range(4):
        df.where((F.col("idx") >= 50 * k) & (F.col("idx") < 50 * k + 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.detect(stream, "user", "idx", "x", D.ddm()).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda d: sorted((r.user, r.idx, r.change, r.warning, round(r.estimate, 9)) for r in d.collect())
    got = spark.table("found")
    assert got.where("late").count() == 0
    assert key(got) == key(D.detect(df, "user", "idx", "x", D.ddm()))


def test_curve_dump(spark, tmp_path):
    from tidemark.streaming.stateful import dump_curve

    dump_curve(spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, None)], "n int, kappa double"), str(tmp_path / "c"), {"kappa": "Kappa"})
    got = spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("n").collect()
    assert [r.Kappa for r in got] == ["0.5", "?", "?"]


def test_curve_rows_and_back(spark):
    curve = spark.createDataFrame([(1, 0.5, None), (2, 0.25, 1.0)], "n int, a double, b double")
    assert sorted(map(tuple, E.curve_columns(E.curve_rows(curve, "n", ["a", "b"]), "n", ["a", "b"]).collect())) == [(1, 0.5, None), (2, 0.25, 1.0)]


def test_boosting_accumulates_the_seen_weight():
    b = N.Boosting(2, 2, lambda i, m: 0.5)
    for i in range(10):
        b.learn(i, i % 2)
    assert b.seen[0] == 10 and b.right[0] + b.wrong[0] == pytest.approx(b.seen[0]) and b.seen[1] > 0


def test_rule_literals_tighten():
    r = R.Rule()
    assert r.add("a", R.AT_MOST, 5) and r.add("a", R.AT_MOST, 3) and not r.add("a", R.AT_MOST, 4) and r.add("a", R.ABOVE, 1)
    assert str(r) == "a <= 3 and a > 1"


def test_rules_and_coverage(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (9.0,), (None,)], "a double")
    rules = [R.Rule([("a", R.AT_MOST, 5.0)]), R.Rule([("a", R.AT_MOST, 2.0)])]
    got = {r.a: (r.f, r.c) for r in df.select("a", R.first_cover(rules).alias("f"), F.size(R.all_covers(rules)).alias("c")).collect()}
    assert got == {1.0: (0, 2), 4.0: (0, 1), 9.0: (-1, 0), None: (-1, 0)}


def test_amrules_learn_a_step(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 100 as double) a", "cast(id % 7 as double) b", "case when id % 100 < 50 then 10.0 else 50.0 end y")
    model = R.AMRules(["a", "b"], {"a": (0.0, 100.0), "b": (0.0, 7.0)})
    for k in range(3):
        model.learn(df.where(F.col("id") % 3 == k), "y")
    assert model.rules and model.rules[0].literals[0][0] == "a"
    assert model.predict(df).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0] < 5


def test_perceptron_learns_a_line():
    rng, p = np.random.default_rng(1), R.Perceptron(2)
    errors = []
    for _ in range(3000):
        x = rng.random(2)
        y = 3 * x[0] - x[1] + 2
        errors.append(abs(p.predict(x) - y))
        p.learn(x, y)
    assert np.mean(errors[-200:]) < 0.3 * np.mean(errors[:200])


def test_hoeffding_tree_splits_and_predicts(spark):
    df = spark.range(6000).selectExpr("id", "cast(id % 100 as double) a", "concat('v', id % 3) n", "case when id % 100 < 30 then 'x' when id % 3 = 1 then 'y' else 'z' end c")
    df = df.union(spark.createDataFrame([(6000, None, None, "x")], df.schema))
    tree = H.HoeffdingTree(["x", "y", "z"], ["a"], ["n"])
    out = H.prequential(df, tree, "id", "c", 4)
    assert tree.sizes()["leaves"] >= 3
    assert out.where("id >= 4500").agg(F.avg((F.col("c") == F.col("pred")).cast("double"))).first()[0] > 0.85
    assert tree.predict(df).where("leaf is null or pred is null").count() == 0


def test_features_add_up(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1), ([2.0, 0.0], 1)], "x array<double>, k int")
    f = C.features(df, "k")
    r = f.select("n", "ls", "ss", C.radius(F.col("n"), F.col("ls"), F.col("ss")).alias("r"), C.variances(F.col("n"), F.col("ls"), F.col("ss")).alias("v")).first()
    assert (r.n, r.ls, r.ss, r.v) == (2, [2.0, 0.0], [4.0, 0.0], [1.0, 1e-50]) and r.r == pytest.approx(0.9)


def test_normal_quantile(spark):
    assert one(spark, C.normal_quantile(F.lit(0.75)))[0] == pytest.approx(0.67449, abs=1e-3)


def test_enclosing_ball():
    c, r = M.enclosing(np.array([[0.0, 0], [2, 0], [1, 0.5], [1, 0]]))
    assert c == pytest.approx([1, 0], abs=1e-5) and r == pytest.approx(1, abs=1e-5)
    s = math.sqrt(3)
    assert M.enclosing(np.array([[0.0, 0], [2, 0], [1, s]]))[1] == pytest.approx(2 / s, abs=1e-5)
    assert M.enclosing(np.array([[1.0, 2], [1, 2]]))[1] == 0


def test_clustream_keeps_all_weight(spark):
    df = spark.range(500).selectExpr("id", "array(cast(id % 5 as double), cast(id % 3 as double) / 100) x")
    got = M.clustream(df, "id", kernels=12, horizon=10_000)
    assert got.agg(F.sum("n")).first()[0] == 500 and got.count() <= 12
    assert M.distributed(df, "id", 2, kernels=12, horizon=10_000).agg(F.sum("weight")).first()[0] == 500


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% note\n@relation toy\n@attribute temp numeric\n@attribute sky {sunny,rain}\n@attribute 'is play' {no,yes}\n@data\n21.5,sunny,yes\n?,rain,no\n{0 18.0,1 rain,2 yes}\n{2 no}\n3,fog,yes\n")
    (tmp_path / "noise").write_text("not a row")
    df = arff.read(spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted([(21.5, "sunny", "yes", 0), (None, "rain", "no", 0), (18.0, "rain", "yes", 0), (0.0, "sunny", "no", 0), (3.0, None, "yes", 1)], key=repr)
    assert df.schema["sky"].metadata["labels"] == ["sunny", "rain"]
    assert arff.read(spark, str(tmp_path), class_index=1).columns == ["sky", "is play", "temp", "bad_labels"]
    arff.write(df.drop("bad_labels").withColumnRenamed("is play", "play"), str(tmp_path / "out"), "toy")
    assert arff.read(spark, str(tmp_path / "out"), glob="*.txt").count() == 5
    with pytest.raises(ValueError):
        arff.header(spark, str(tmp_path / "noise"), glob="")


def test_generators_do_not_depend_on_partitions(spark):
    for make in (lambda: G.random_tree(spark, 300), lambda: G.hyperplane(spark, 300, change=0.01), lambda: G.RandomRBF(events=True, every=100).rows(spark, 300)):
        rows = sorted(map(tuple, make().collect()))
        assert rows == sorted(map(tuple, make().repartition(3).collect())) and len(rows) == 300
    assert {r["class"] for r in G.random_tree(spark, 300).collect()} == {"class1", "class2"}
    inside = G.RandomRBF(noise=0.0).rows(spark, 200)
    assert all(0 <= r.att1 <= 1 and 0 <= r.att2 <= 1 and r["class"] < 5 for r in inside.collect())


def test_registry():
    assert registry.parse("bagging -l (tree -g 200 -b) -s 1.5 -f -3") == ("bagging", {"l": ("tree", {"g": 200, "b": True}), "s": 1.5, "f": -3})
    assert isinstance(registry.create("detector", "cusum -bar 5"), D.Detector)
    with pytest.raises(KeyError):
        registry.create("detector", "none")
    for bad in ("", "a (b", "a b"):
        with pytest.raises(ValueError):
            registry.parse(bad)


def test_prequential_task(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 10 as double) a", "case when id % 10 < 5 then 'x' else 'y' end c")
    curve = tasks.prequential(df, "id", "c", ["x", "y"], learner="hoeffding", numeric=["a"], every=400, batches=4).orderBy("n").collect()
    assert [r.n for r in curve] == [400, 800, 1000] and curve[-1].accuracy > curve[0].accuracy
    assert tasks.prequential(df, "id", "c", ["x", "y"], limit=100, every=60).count() == 2
    with pytest.raises(ValueError):
        tasks.prequential(df, "id", "c", ["x", "y"], learner="none")
