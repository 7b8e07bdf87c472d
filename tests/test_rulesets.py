"""Replicated rule sets and the index of many rules."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import rulesets
from tidemark.operators.forest import batched
from tidemark.operators.rules import ABOVE, AT_MOST, Rule
from tidemark.operators.rulesets import Known, RuleIndex, RuleSet, covered
from tidemark.storage import fresh_folder
from tidemark.streaming import models

RANGES = {"a": (0.0, 1.0), "b": (0.0, 10.0)}


def rows(n, seed=2, turn=None):
    rng, out = random.Random(seed), []
    for i in range(n):
        a, b = rng.random(), rng.choice([None, rng.random() * 10])
        y = (50.0 if a > 0.6 else 5.0) + (3.0 * b if b is not None else 0.0)
        if turn is not None and i >= turn and a > 0.6:
            y = 500.0 - y
        out.append((i, a, b, y + rng.random(), 1.0))
    return out


SCHEMA = "i long, a double, b double, y double, w double"


def learned(spark, data, batches=4, parts=3, weight=None, **options):
    model = RuleSet(list(RANGES), RANGES, **({"grace": 100, "delta": 1e-3, "tie": 0.1} | options))
    df = spark.createDataFrame(data, SCHEMA).repartition(parts).selectExpr("*", "'z' as x", "1 as rule")
    folder = fresh_folder(spark, "r")
    if weight is None:
        batched(df, model, "i", "y", batches, folder)
    else:
        model.test_then_learn(df, "i", "y", f"{folder}/rows/batch=0", weight)
    return model, spark.read.schema(f"{rulesets.PASSED}, batch int").parquet(f"{folder}/rows").where("part = 'row'")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 300])
def test_bitmaps_are_what_rule_by_rule_gives(n):
    rng = random.Random(n)
    pick = lambda: [(rng.choice(["a", "b"]), rng.choice([AT_MOST, ABOVE]), float(rng.randrange(10))) for _ in range(rng.randrange(4))]
    rules = [Rule([])] if n == 1 else []
    while len(rules) < n:
        rule = Rule([])
        for literal in pick():
            rule.add(*literal)
        rules.append(rule)
    x = np.array([[rng.choice([math.nan, *map(float, range(-1, 11)), rng.random() * 10]) for _ in range(2)] for _ in range(500)])
    want = np.array([[all((v[{"a": 0, "b": 1}[at]] <= c) if o == AT_MOST else (v[{"a": 0, "b": 1}[at]] > c) for at, o, c in r.literals) for r in rules] for v in x]).reshape(500, n)
    index = RuleIndex.of(rules, ["a", "b"])
    bits = index.covers(x)
    assert index.first(bits).tolist() == [int(w.argmax()) if w.any() else -1 for w in want]
    assert np.bitwise_count(bits).sum(1).tolist() == want.sum(1).tolist()
    row, rule = index.all(bits)
    assert (np.array(np.nonzero(want)) == np.array([row, rule])).all()


def test_covered_keeps_columns_and_takes_nulls(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, 3.0), (3, 0.9, 9.0)], "i long, a double, b double").selectExpr("*", "'k' as covers_", "1 as _x_")
    got = covered(df, [Rule([("a", AT_MOST, 0.6)]), Rule([("b", ABOVE, 2.0)]), Rule([("a", ABOVE, 0.4)])], ["i", "covers_"]).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "k", 0, 2), (2, "k", 1, 1), (3, "k", 1, 2)]


@pytest.mark.parametrize("ordered", [True, False])
def test_rules_do_not_depend_on_partitions(spark, ordered):
    data = rows(1500)
    made = [learned(spark, data, parts=p, ordered=ordered) for p in (1, 4, 16)]
    logs = [[(*r[:5], round(r[5], 9)) for r in m.log] for m, _ in made]
    assert logs[0] == logs[1] == logs[2] and any(e[1] == "new" and e[3] == "a" for e in logs[0])
    preds = [[round(r.pred, 6) for r in out.orderBy("idx").collect()] for _, out in made]
    assert preds[0] == preds[1] == preds[2] and len(preds[0]) == 1500
    last = [r for r in made[0][1].where("batch = 3").collect()]
    assert sum(abs(r.pred - r.y) for r in last) / len(last) < 0.5 * float(np.std([r.y for r in last]))
    table = made[0][0].table(spark).collect()
    assert table and {r.version for r in table} == {4}


def test_a_weight_of_two_is_the_row_twice_and_missing_values_count_in_nothing(spark):
    data = rows(300)
    twice, _ = learned(spark, [r for r in data for _ in range(2)], weight="w", grace=10**9)
    heavy, _ = learned(spark, [(*r[:4], 2.0) for r in data], weight="w", grace=10**9)
    for s in Known.STATE:
        assert np.allclose(getattr(twice.default, s), getattr(heavy.default, s)), s
    there = [r for r in data if r[2] is not None]
    assert np.allclose(heavy.default.moments[1], [2 * len(there), 2 * sum(r[2] for r in there), 2 * sum(r[2] ** 2 for r in there)])
    assert heavy.default.cells[1].sum(0)[0] == 2 * len(there) and heavy.default.total[0] == 600
    none, out = learned(spark, [(*r[:3], None, 1.0) for r in data] + [(*r[:4], None) for r in data[:5]], weight="w")
    assert none.default.total[0] == 0 and out.count() == 305


def test_rules_that_fail_go_and_the_log_says_so(spark):
    model, _ = learned(spark, rows(2000, turn=1400), batches=10, rise=0.5)
    events = [e for _, e, *_ in model.log]
    gone = {r for _, e, r, *_ in model.log if e == "removed"}
    assert gone and gone.isdisjoint({r.number for r in model.rules}) and "new" in events
    assert model.logged(spark).count() == len(model.log) and model.version == 10


def test_the_linear_predictor_is_used_where_its_error_is_lower(spark):
    rng = random.Random(1)
    data = [(i, a := rng.random(), b := rng.random() * 10, 20 * a - 3 * b, 1.0) for i in range(600)]
    by = {p: learned(spark, data, grace=10**9, predictor=p)[1].where("batch = 3").collect() for p in ("mean", "linear", "adaptive")}
    error = {p: sum(abs(r.pred - r.y) for r in out) / len(out) for p, out in by.items()}
    assert error["linear"] < 0.01 and error["adaptive"] < 0.01 and error["mean"] > 3
    with pytest.raises(ValueError, match="no predictor"):
        RuleSet(["a"], RANGES, predictor="best")


def test_anomalies_are_not_learned():
    model = RuleSet(list(RANGES), RANGES)
    rule = Known(1, 2, 32)
    rule.moments = np.array([[100.0, 50.0, 25.5], [100.0, 500.0, 2600.0]])
    odd = model._deviates(rule, np.array([[0.5, 5.0], [0.5, 90.0], [np.nan, np.nan], [9.0, 5.0], [0.45, 6.0]]))
    assert odd.tolist() == [False, True, False, True, False]


@pytest.mark.parametrize("ordered", [True, False])
def test_a_stream_of_versions_goes_on_from_its_store(spark, ordered):
    data = rows(900)
    folder = fresh_folder(spark, "s")
    for k in range(0, 900, 300):
        spark.createDataFrame(data[k : k + 300], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    make = lambda: RuleSet(list(RANGES), RANGES, grace=100, delta=1e-3, tie=0.1, ordered=ordered)
    store = models.Store(spark, f"{folder}/store")
    models.learn(stream, make(), store, "i", "y", f"{folder}/c").awaitTermination()
    whole, out = learned(spark, data, batches=3, ordered=ordered)
    last = make().restored(store.latest()[2])
    assert [r[:5] for r in last.log] == [r[:5] for r in whole.log] and last.version == 3
    got = {r.idx: round(r.pred, 6) for r in store.rows(rulesets.PASSED).collect()}
    assert got == {r.idx: round(r.pred, 6) for r in out.collect()}
