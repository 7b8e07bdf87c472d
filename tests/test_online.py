import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import flows, protocols, registry, tasks
from tidemark.operators import drift as D
from tidemark.operators import hoeffding as H
from tidemark.operators import observers as O
from tidemark.operators import online as L
from tidemark.operators import rules as R


def stream(n, seed=1, turn=None):
    """Rows of two numbers and a name; the class is a corner of the plane, or its opposite after `turn`."""
    rng = np.random.default_rng(seed)
    for i in range(n):
        x = {"a": float(rng.random()), "b": float(rng.random()), "c": "xyz"[int(rng.integers(3))]}
        yield x, int((x["a"] > 0.5) != (turn is not None and i >= turn))


def score(learner, rows):
    hits = []
    for x, y in rows:
        votes = learner.votes(x)
        hits.append(votes.index(max(votes)) == y)
        learner.learn(x, y)
    return hits


def test_learners_learn():
    for learner, least in ((L.NaiveBayes(2), 0.9), (L.Tree(2, grace=50), 0.85), (L.Bagging(lambda: L.Tree(2, grace=50), 3, 2), 0.85), (L.Boosting(lambda: L.NaiveBayes(2), 3, 2), 0.85)):
        assert np.mean(score(protocols.check(learner, protocols.Learner), stream(1500))[500:]) > least
    assert L.Majority(3).votes({}) == [0, 0, 0]


def test_bayes_as_by_counting():
    model, rows = L.NaiveBayes(2), list(stream(60))
    for x, y in rows:
        model.learn(x, y, 2.0)
    x = {"a": 0.3, "b": None, "c": "x"}
    want = []
    for c in range(2):
        a = np.array([r["a"] for r, y in rows if y == c])
        var = 2 * ((a - a.mean()) ** 2).sum() / (2 * len(a) - 1)
        share = np.mean([r["c"] == "x" for r, y in rows if y == c])
        want.append(len(a) / 60 * math.exp(-((0.3 - a.mean()) ** 2) / (2 * var)) / math.sqrt(2 * math.pi * var) * share)
    assert model.votes(x) == pytest.approx(want)


def test_tree_splits_when_the_grace_period_is_over():
    tree = L.Tree(2, grace=100, tie=0.5)
    for k, (x, y) in enumerate(stream(100)):
        assert not tree.tree.root.children
        tree.learn(x, y)
    root = tree.tree.root
    assert root.attribute == "a" and abs(root.cut - 0.5) < 0.1 and tree.votes({"a": None, "b": 1.0}) in [c.counts.tolist() for c in root.children]


def test_adaptive_learner_starts_anew_after_a_turn():
    plain, adaptive = L.NaiveBayes(2), L.Adaptive(lambda: L.NaiveBayes(2), D.ddm())
    rows = list(stream(3000, turn=1500))
    assert np.mean(score(adaptive, rows)[2000:]) > 0.9 > np.mean(score(plain, rows)[2000:]) and adaptive.resets == 1


def rule_stream(n, seed=2, turn=None):
    rng = np.random.default_rng(seed)
    for i in range(n):
        x = {"a": float(rng.random()), "b": float(rng.random())}
        low, high = (10.0, 20.0) if turn is None or i < turn else (200.0, -200.0)
        yield x, (low if x["a"] <= 0.5 else high + 5 * x["b"]) + float(rng.normal(0, 0.1))


@pytest.mark.parametrize("ordered", [True, False])
def test_rules_expand_and_predict(ordered):
    model, errors = L.Rules(["a", "b"], grace=100, ordered=ordered), []
    for x, y in rule_stream(3000):
        errors.append(abs(model.votes(x)[0] - y))
        model.learn(x, y)
    assert model.rules and {a for rule, _ in model.rules for a, _, _ in rule.literals} >= {"a"}
    assert np.mean(errors[2000:]) < 1.5 < np.mean(errors[:100]) and model.dropped == 0
    assert math.isfinite(model.votes({"a": None, "b": None})[0])
    model.learn({"a": 0.1}, None)  # nothing to learn


def test_rules_go_after_a_change_and_leave_anomalies_out():
    model = L.Rules(["a", "b"], grace=100)
    for x, y in rule_stream(4000, turn=2500):
        model.learn(x, y)
    assert model.dropped > 0
    node = L.RuleNode(["a", "b"])
    for x, y in rule_stream(200):
        node.learn(np.array([x["a"], x["b"]]), y)
    assert node.deviates(np.array([40.0, 40.0])) and not node.deviates(np.array([0.5, 0.5])) and not node.deviates(np.array([math.nan, 0.5]))


def test_the_better_of_perceptron_and_mean_predicts():
    node, flat = L.RuleNode(["a"]), L.RuleNode(["a"])
    rng = np.random.default_rng(3)
    for v in rng.random(800):
        node.learn(np.array([v]), 10 * v)
        flat.learn(np.array([v]), float(rng.normal(3, 0.01)))
    assert node._linear() and abs(node.predict(np.array([0.9])) - 9) < 1
    assert flat.predict(np.array([0.9])) == pytest.approx(3, abs=0.05)
    assert L.RuleNode(["a"], predictor="mean").predict(np.array([1.0])) == 0


def test_prequential_by_is_the_fold_of_each_key(spark):
    rows = [(k, i, *x.values(), y) for k in range(3) for i, (x, y) in enumerate(stream(80, seed=k))]
    df = spark.createDataFrame([*rows, (None, 1, 0.5, 0.5, "x", 1), (0, 900, None, None, None, None)], "key long, idx long, a double, b double, c string, y int")
    out = {(r.key, r.idx): r.pred for r in L.prequential_by(df, "key", "idx", ["a", "b", "c"], "y", lambda: L.NaiveBayes(2), 2).collect()}
    for k in range(3):
        model = L.NaiveBayes(2)
        for i, (x, y) in enumerate(stream(80, seed=k)):
            votes = model.votes(x)
            assert out[k, i] == votes.index(max(votes))
            model.learn(x, y)
    assert out[None, 1] == 0 and (0, 900) in out and len(out) == 242


def test_batch_rules_take_missing_values(spark):
    rows = [(float(i % 10), float(i % 7) if i % 5 else None, 1.0 if i % 10 < 5 else 9.0) for i in range(400)] + [(1.0, 1.0, None), (None, None, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = R.AMRules(["a", "b"], {"a": (0.0, 10.0), "b": (0.0, 7.0)}, grace=100)
    for _ in range(3):
        model.learn(df, "y")
    assert model.rules and model.rules[0].literals[0][0] == "a"
    stats = [r.stats for r in [*model.rules, model.default] if r.stats is not None]
    assert stats and all(s[1].sum(0)[0] <= s[2, 0, 0] for s in stats)


def test_topology(spark):
    out = flows.hello_world(20, 3)
    assert out.stream(spark, "shouted").where("text = upper(text) and text like 'HELLO %'").count() == 20
    with pytest.raises(ValueError):
        out.through("x", flows.Step(lambda df: df), "nowhere")
    with pytest.raises(ValueError):
        out.source("greetings", flows.Greetings(1))
    with pytest.raises(TypeError):
        out.source("odd", object())
    with pytest.raises(ValueError):
        flows.Topology("empty").stream(spark, "a")
    df = spark.range(10)
    assert flows.dealt(df, flows.SHUFFLE, 3).rdd.getNumPartitions() == 3 and flows.dealt(df, flows.ALL, 4).count() == 40
    by_key = flows.dealt(spark.range(100).withColumn("k", F.col("id") % 5), flows.KEY, 3, "k").withColumn("p", F.spark_partition_id())
    assert by_key.groupBy("k").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    for how, key, n in (("odd", None, 2), (flows.KEY, None, 2), (flows.SHUFFLE, None, 0)):
        with pytest.raises(ValueError):
            flows.dealt(df, how, n, key)


def test_registry_makes_parts_of_the_right_shape():
    bagged = registry.create("learner", "adaptive_bagging -models 3 -l (tree -grace 50) -d (ddm -warn 1.5)", classes=2)
    assert len(bagged.learners) == 3 and isinstance(bagged.learners[0].learner, L.Tree) and bagged.learners[0].learner.tree.grace == 50
    assert isinstance(registry.create("observer", "nothing"), protocols.Observer) and registry.create("observer", "nothing").cuts() == []
    assert isinstance(registry.create("evaluator", "window -width 50", classes=2), protocols.Evaluator)
    registry.register("learner", "wrong", object)
    with pytest.raises(TypeError):
        registry.create("learner", "wrong")
    with pytest.raises(KeyError):
        registry.create("learner", "bagging -l (unknown)")
    assert len(registry.KINDS) >= 12


def test_schema_check(spark):
    df = spark.range(1).selectExpr("id", "'x' as name")
    assert protocols.check_schema(df, ["id"], ["name"]) is df
    for bad in (dict(numeric=["name"]), dict(nominal=["none"]), dict(target="none")):
        with pytest.raises(ValueError):
            protocols.check_schema(df, **bad)


def test_rows_that_only_train(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(90)], "idx long, y string")
    out = tasks.prequential(df, "idx", "y", ["a", "b"], every=10, test_every=4, warm_up=10).orderBy("n").collect()
    pred, seen, hits = [], [0, 0], []
    for i in range(90):
        y = int(i % 3 == 0)
        pred.append(int(seen[1] > seen[0]))
        if i >= 10 and (i - 10) % 4 == 0:
            hits.append(pred[-1] == y)
        seen[y] += 1
    assert [(r.n, r.accuracy) for r in out] == [(n, pytest.approx(100 * np.mean(hits[:n]))) for n in (10, 20)]


def test_quantile_summary_merges_only_what_is_no_surer():
    q = O.Quantiles(10)
    for v in np.random.default_rng(1).permutation(1000):
        q.add(float(v))
        assert len(q.tuples) <= 10 and sum(t[1] for t in q.tuples) == q.n
    ranks = np.cumsum([t[1] for t in q.tuples])
    for (v, _, d), rank in zip(q.tuples, ranks):
        assert rank - 1 <= v <= rank + d  # the true rank lies between the bounds
    assert H.info_gain(np.array([1.0, 1.0]), [np.array([1.0, 0]), np.array([0, 1.0])]) == 1


@pytest.mark.parametrize("block", [1024, 7])
def test_cmm_as_point_by_point(spark, monkeypatch, block):
    from tidemark.operators import clustering as C
    from tidemark.operators import micro as M

    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = np.r_[rng.standard_normal((12, 2)), rng.standard_normal((12, 2)) + 2.5, rng.standard_normal((4, 2)) * 3, [[50.0, 50.0]]]
    label = [0] * 12 + [1] * 12 + [-1] * 4 + [2]
    clusters = [{"cluster": j, "centre": c, "radius": r, "weight": 9.0} for j, c, r in ((0, [0.0, 0.0], 1.2), (1, [2.5, 2.5], 1.5), (2, [1.0, 1.0], 1.4))]
    points = spark.createDataFrame([(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label))], "id long, x array<double>, label int")
    near = lambda i, c: sorted(np.linalg.norm(x[i] - x[j]) for j in range(29) if j != i and label[j] == c)[:2]
    knn = {(i, c): np.mean(near(i, c)) if near(i, c) else None for i in range(29) for c in (0, 1, 2)}
    usual = {c: np.mean(v) if (v := [knn[i, c] for i in range(29) if label[i] == c and knn[i, c] is not None]) else None for c in (0, 1, 2)}
    con = {(i, c): float(label[i] == c) if usual[c] is None else 1.0 if v <= usual[c] else usual[c] / v for (i, c), v in knn.items()}
    held = [[j for j, c in enumerate(clusters) if np.linalg.norm(v - c["centre"]) <= c["radius"]] for v in x]
    stands = {j: max((0, 1, 2), key=lambda c: (sum(j in held[i] for i in range(29) if label[i] == c), -c)) for j in range(3)}
    top = missed = misplaced = noise = 0.0
    for i, y in enumerate(label):
        best = max((con[i, stands[j]] for j in held[i]), default=0.0)
        top += 1.0 if y == -1 else con[i, y]
        if y == -1:
            noise += best
        elif not held[i]:
            missed += con[i, y]
        elif y not in [stands[j] for j in held[i]]:
            misplaced += con[i, y] * (1 - best)
    out = M.cmm(points, clusters).first()
    assert (out.missed, out.misplaced, out.noise) == pytest.approx((missed / top, misplaced / top, noise / top)) and out.cmm == pytest.approx(1 - (missed + misplaced + noise) / top)
    tied = M.joined_classes(M.connectivity(points), 0.01)
    assert tied[0] == tied[1] == 0 and tied[2] == 2
    assert M.cmm(points.where("false"), clusters).first().cmm == 1


def test_horizons_are_windows_of_their_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(2) * 0.1 + (5 if i % 2 else 0)).tolist(), i % 2) for i in range(250)]
    out = tasks.clustering_evaluation(spark.createDataFrame(rows, "id long, x array<double>, label int"), "id", kernels=10, horizon=100, k=2).orderBy("horizon").collect()
    assert [r.horizon for r in out] == [0, 1, 2] and all(r.ssq < 0.1 * 100 and 0.5 < r.rand <= 1 and 0 < r.van_dongen <= 1 for r in out)
    alone = tasks.clustering_evaluation(spark.createDataFrame(rows[:100], "id long, x array<double>, label int"), "id", kernels=10, horizon=100, k=2).first()
    assert alone.ssq == pytest.approx(out[0].ssq)


def test_missing_values_count_in_no_moments():
    """A rule node and its perceptron learn what is there, and nothing for what is not."""
    from tidemark.operators.online import RuleNode
    from tidemark.operators.rules import Perceptron

    node, rng = RuleNode(["a", "b"]), random.Random(3)
    there = []
    for i in range(100):
        a, b = rng.random(), rng.random() if i % 3 else math.nan
        there += [b] if i % 3 else []
        node.learn(np.array([a, b]), 2 * a)
    assert node.perceptron.s[0].tolist() == [100, len(there)]
    assert node.perceptron.s[1][1] == pytest.approx(sum(there)) and node.perceptron.s[2][1] == pytest.approx(sum(v * v for v in there))
    assert not node.deviates(np.array([0.5, math.nan])) and math.isfinite(node.predict(np.array([math.nan, math.nan])))
    p = Perceptron(1)
    p.learn(np.array([math.nan]), 3.0)
    assert p.s.tolist() == [[0.0], [0.0], [0.0]] and p.predict(np.array([math.nan])) == 3.0


def test_a_rule_learner_takes_a_weight_of_two_as_the_row_twice():
    from tidemark.operators.online import Rules

    rng = random.Random(4)
    rows = [{"a": rng.random(), "b": rng.random()} for _ in range(600)]
    one, two = Rules(["a", "b"], grace=50, delta=0.1, tie=0.3), Rules(["a", "b"], grace=50, delta=0.1, tie=0.3)
    for x in rows:
        y = 10.0 if x["a"] > 0.5 else 0.0
        one.learn(x, y, 2.0)
        two.learn(x, y)
        two.learn(x, y)
        one.learn(x, y, 0.0)
    assert [r.literals for r, _ in one.rules] == [r.literals for r, _ in two.rules] and one.rules
    assert one.votes(rows[0]) == two.votes(rows[0])
    with pytest.raises(ValueError, match="no number of times"):
        one.learn(rows[0], 1.0, 0.5)


def test_a_full_tree_does_not_walk_its_leaves(monkeypatch):
    tree, r = L.Tree(2, grace=20, tie=0.9, max_leaves=4), np.random.default_rng(1)
    walks = []
    leaves = type(tree.tree).leaves
    monkeypatch.setattr(type(tree.tree), "leaves", lambda self: walks.append(1) or leaves(self))
    for a, b in r.random((3000, 2)).tolist():
        tree.learn({"a": a, "b": b}, int(a + b > 1))
    assert not walks and len(leaves(tree.tree)) == 4


@pytest.mark.parametrize("ordered", [True, False])
def test_rules_that_cover_a_row_by_bits(ordered):
    model, r = L.Rules(["a", "b"], ordered=ordered), np.random.default_rng(2)
    for k in range(40):
        rule = R.Rule([("ab"[i], o, round(float(r.random()), 1)) for i in (0, 1) for o in (R.AT_MOST, R.ABOVE) if r.random() < 0.5])
        model.rules.append((rule, model._node()))
    values = [math.nan, *(k / 20 for k in range(21))]
    for a in values:
        for b in values:
            want = [k for k, (rule, _) in enumerate(model.rules) if all(({"a": a, "b": b}[n] <= v) if o == R.AT_MOST else ({"a": a, "b": b}[n] > v) for n, o, v in rule.literals)]
            assert model._covering([a, b]) == (want[:1] if ordered else want or [-1])
    assert model._tests is not None
