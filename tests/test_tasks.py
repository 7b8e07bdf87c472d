"""Ensembles, rule sets and horizon measures by their tasks and names; splits and trees on attributes of many values."""

import random

import pytest

from tidemark import registry, tasks
from tidemark.operators import hoeffding, statistics
from tidemark.operators.rulesets import RuleSet


def rows(spark, n=600):
    rng = random.Random(9)
    data = [(7 * i, rng.random(), rng.choice("uvw")) for i in range(n)]
    return spark.createDataFrame([(i, a, c, "on" if (a > 0.4) != (c == "u") else "off") for i, a, c in data], "t long, a double, c string, y string")


@pytest.mark.parametrize("line", ["single", "bagging -models 3", "boosting -models 3", "adaptive -models 3 -detector (rising -rise 0.2)"])
def test_forests_by_name_in_the_prequential_task(spark, line):
    model = registry.create("forest", line, classes=["off", "on"], numeric=["a"], nominal=["c"], grace=50, delta=0.05, tie=0.3)
    curve = tasks.prequential(rows(spark), "t", "y", ["off", "on"], model, every=200, batches=6).orderBy("n").collect()
    assert [r.n for r in curve] == [200, 400, 600] and curve[-1].accuracy > 60
    with pytest.raises(ValueError, match="other classes"):
        tasks.prequential(rows(spark), "t", "y", ["on", "off"], model)


def test_rule_sets_and_horizons_by_name(spark):
    assert isinstance(registry.create("rule_set", "rules -grace 30", attributes=["a"], ranges={"a": (0.0, 1.0)}), RuleSet)
    run = registry.create("task", "clustering_horizons -every 20 -panes 2", measures=["purity", "ssq"])
    points = spark.createDataFrame([(i, [float(i % 3)], i % 3) for i in range(60)], "t long, x array<double>, label int")
    spheres = [{"cluster": k, "centre": [float(k)], "radius": 0.2, "weight": 20.0} for k in range(3)]
    got = {(r.sample, r.measure): r.value for r in run(points, "t", spheres).collect()}
    assert got == {(s, m): v for s in range(3) for m, v in (("purity", 1.0), ("ssq", 0.0))}


def test_a_split_needs_two_branches_of_some_weight(spark):
    cells = [("few", 0, "a", 1000.0), ("few", 1, "b", 9.0), ("many", 0, "a", 500.0), ("many", 1, "b", 400.0), ("many", 2, "a", 1.0), *(("spread", k, "a", 1.0) for k in range(200)), ("one", 0, "a", 3.0), ("one", 0, "b", 2.0)]
    df = spark.createDataFrame(cells, "k string, branch int, y string, weight double")
    got = {r.k: r.merit for r in statistics.info_gain(df, ["k"], "y").collect()}
    assert got["few"] is None and got["one"] is None and got["spread"] is None and got["many"] > 0.9


def test_a_batch_tree_refuses_attributes_of_very_many_values(spark):
    df = spark.range(100).selectExpr("id", "cast(id as string) as c", "cast(id % 2 as string) as y")
    with pytest.raises(ValueError, match="more than 20 values"):
        hoeffding.HoeffdingTree(["0", "1"], [], ["c"], max_values=20).learn(df, "y")
    assert len(hoeffding.HoeffdingTree(["0", "1"], [], ["c"], max_values=100).learn(df, "y").root.nominal["c"]) == 100
