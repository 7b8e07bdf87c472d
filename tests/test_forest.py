"""Trees and ensembles over micro-batches: one row a batch is the row-by-row learner; nothing depends on how rows lie."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import drift, forest, online
from tidemark.operators.ensembles import _uniform, poisson_sample
from tidemark.operators.forest import Forest
from tidemark.storage import fresh_folder, names
from tidemark.streaming import models

OPTIONS = {"grace": 20, "delta": 0.05, "tie": 0.3}


def rows(n, seed=1, turn=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.random(), rng.choice([None, 1.0, 2.0, 5.0]), rng.choice(["x", "y", "z", None])
        y = int((a > 0.5) != (c == "x")) if turn is None or i < turn else int((a > 0.5) == (c == "x"))
        out.append((i, y if rng.random() < 0.95 else None, a, b, c))
    return out


def batch(part, models):
    idx, y, a, b, c = zip(*part)
    arrays = [pa.array(idx, pa.int64()), pa.array(y, pa.int32()), pa.array([[_uniform(i, k) for k in range(models)] for i in idx], pa.list_(pa.float64())), pa.array(a), pa.array(b, pa.float64()), pa.array(c, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["idx", "y", "draws", "a", "b", "c"])


def stepped(model, part):
    """One micro-batch in this process: the pass over two partitions, and the merged cube."""
    k = len(part) // 2
    out, cells = [], {}
    for half in (part[:k], part[k:]):
        if half:
            for got in model.passed(iter([batch(half, len(model.trees))])):
                for r in got.to_pylist():
                    if r["part"] == "row":
                        out.append(r["pred"])
                        continue
                    key = tuple(r[c] for c in ("model", "leaf", "attribute", "value", "cls"))
                    old = cells.get(key)
                    cells[key] = r if old is None else old | {c: old[c] + r[c] for c in "nsq"} | {"low": min(old["low"], r["low"]), "high": max(old["high"], r["high"])}
    model.learn(list(cells.values()))
    return out


def made(kind, models=3, **more):
    detector = drift.ddm() if kind == "adaptive" else None
    return Forest(["0", "1"], ["a", "b"], ["c"], 1 if kind == "single" else models, kind, detector, **OPTIONS, **more)


class Watched(online.Adaptive):
    """Its detector sees every row, learned or not."""

    def watch(self, miss):
        self.state, change, _, estimate = self.detector.step(self.state, miss)
        if change and estimate > self.estimate:
            self.resets += 1
            self._start()
        else:
            self.estimate = estimate


class WatchedBagging(online.Bagging):
    def learn(self, x, y, weight=1.0):
        for k, m in enumerate(self.learners):
            votes = m.votes(x)
            times = poisson_sample(self.draw(self.seen, k), 1.0)
            if times:
                m.learner.learn(x, y, times)
            m.watch(float(votes.index(max(votes)) != y))


def row_by_row(kind):
    tree = lambda: online.Tree(2, **OPTIONS)
    if kind == "single":
        return tree()
    if kind == "boosting":
        return online.Boosting(tree, 3, 2)
    return online.Bagging(tree, 3, 2) if kind == "bagging" else WatchedBagging(lambda: Watched(tree, drift.ddm()), 3, 2)


@pytest.mark.parametrize("kind", ["single", "bagging", "boosting", "adaptive"])
def test_batches_of_one_row_are_the_row_by_row_learner(kind):
    data, fast, slow = rows(900, turn=450), made(kind), row_by_row(kind)
    same = 0
    for k, (i, y, a, b, c) in enumerate(data):
        x = {"a": a, "b": b, "c": c}
        votes = [round(v, 9) for v in slow.votes(x)]
        assert stepped(fast, [data[k]]) == [votes.index(max(votes))], k
        same += votes.index(max(votes)) == y
        if y is not None:
            if kind != "single":
                setattr(slow, "count" if kind == "boosting" else "seen", i)  # draws are by the row's number
            slow.learn(x, y)
    assert same > 500
    leaves = [len(t.leaves()) for t in fast.trees]
    learners = [slow] if kind == "single" else [m.learner if kind == "adaptive" else m for m in slow.learners]
    assert leaves == [len(m.tree.leaves()) for m in learners] and max(leaves) > 2
    if kind == "adaptive":
        assert fast.resets == [m.resets for m in slow.learners] and sum(fast.resets) > 0


def test_poisson_as_by_inversion_one_by_one():
    rng = np.random.default_rng(1)
    u, rate = rng.random(3000), np.concatenate([rng.random(1500) * 3, rng.random(1000) * 120, np.zeros(500)])
    assert forest.poisson(u, rate).tolist() == [poisson_sample(a, b) for a, b in zip(u, rate)]


@pytest.mark.parametrize("kind", ["single", "bagging", "boosting", "adaptive"])
def test_larger_batches_learn_and_a_stored_model_goes_on_as_it_was(kind):
    data, one, two = rows(4000), made(kind), made(kind)
    hits = 0
    for k in range(0, 4000, 250):
        part = data[k : k + 250]
        got = stepped(one, part)
        two = made(kind).restored(two.to_json())
        assert stepped(two, part) == got
        hits += sum(g == r[1] for g, r in zip(got, part))
    assert hits > 0.75 * 4000 * 0.95
    assert one.to_json() == two.to_json()


def test_a_tree_of_one_batch_is_the_batch_tree(spark):
    from tidemark.operators.hoeffding import HoeffdingTree

    data = rows(600)
    df = spark.createDataFrame(data, "i long, y int, a double, b double, c string")
    tree = HoeffdingTree(["0", "1"], ["a", "b"], ["c"], **OPTIONS).learn(df.withColumn("y", df.y.cast("string")), "y")
    got = made("single")
    out = forest.prequential(df.repartition(5), got, "i", "y", 1, fresh_folder(spark, "t"))
    assert out.count() == 600 and got.sizes() == [tree.sizes()]
    assert [n.attribute for n in _inner(got.trees[0].root)] == [n.attribute for n in _inner(tree.root)]


def _inner(n):
    return [n, *(m for c in n.children for m in _inner(c))] if n.children else []


@pytest.mark.parametrize("kind", ["bagging", "boosting"])
def test_results_do_not_depend_on_partitions(spark, kind):
    df = spark.createDataFrame(rows(800), "i long, y int, a double, b double, c string").selectExpr("*", "'x' as part", "1 as draws", "2 as idx")
    found = []
    for parts in (1, 4, 16):
        out = forest.prequential(df.repartition(parts), made(kind), "i", "y", 4, fresh_folder(spark, "t"))
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 800
    assert forest.prequential(df.where("false"), made(kind), "i", "y", 2, fresh_folder(spark, "t")).count() == 0


def test_nominal_attributes_of_very_many_values_are_refused():
    part = [(i, i % 2, 0.5, 1.0, f"v{i}") for i in range(50)]
    with pytest.raises(ValueError, match="more than 40 values"):
        stepped(made("single", max_values=40), part)
    with pytest.raises(ValueError, match="do not go together"):
        Forest(["a"], models=3)


def _files(spark, folder, data, size):
    for k in range(0, len(data), size):
        spark.createDataFrame(data[k : k + size], "i long, y int, a double, b double, c string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("i long, y int, a double, b double, c string").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("rows_a_run", [None, 40])
@pytest.mark.parametrize("where", ["before the marker", "after the marker"])
def test_a_batch_that_comes_again_is_learned_once(spark, monkeypatch, where, rows_a_run):
    """The stream is killed between learning and its checkpoint; the tree and the predictions are those of a run without a fault."""
    data = rows(400)
    folder = fresh_folder(spark, "s")
    stream = _files(spark, f"{folder}/in", data, 100)
    whole = models.Store(spark, f"{folder}/whole")
    models.learn(stream, made("bagging"), whole, "i", "y", f"{folder}/c0", rows_a_run).awaitTermination()
    store, real, calls = models.Store(spark, f"{folder}/store"), models.Store.commit, []

    def dying(self, attempt, model):
        calls.append(attempt)
        if len(calls) == 3 and where == "before the marker":
            raise RuntimeError("killed")
        real(self, attempt, model)
        if len(calls) == 3:
            raise RuntimeError("killed")

    monkeypatch.setattr(models.Store, "commit", dying)
    with pytest.raises(Exception, match="killed"):
        models.learn(stream, made("bagging"), store, "i", "y", f"{folder}/c1", rows_a_run).awaitTermination()
    monkeypatch.setattr(models.Store, "commit", real)
    models.learn(stream, made("bagging"), store, "i", "y", f"{folder}/c1", rows_a_run).awaitTermination()
    assert store.latest() == whole.latest() and whole.latest()[0] == 3
    assert sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, whole.rows().collect())) and store.rows().count() == 400
    assert len([n for n in names(spark, store.folder) if n.startswith("model-")]) == 1
    # a batch that is long done is left out
    models.learned(spark.createDataFrame(data[:5], "i long, y int, a double, b double, c string"), 1, made("bagging"), store, "i", "y", rows_a_run)
    assert store.rows().count() == 400


def test_streamed_rows_one_by_one_are_the_row_by_row_tree(spark):
    data, slow, want = rows(60), online.Tree(2, **OPTIONS), []
    for i, y, a, b, c in data:
        votes = slow.votes({"a": a, "b": b, "c": c})
        want.append(votes.index(max(votes)))
        if y is not None:
            slow.learn({"a": a, "b": b, "c": c}, y)
    folder = fresh_folder(spark, "s")
    store = models.Store(spark, f"{folder}/store")
    models.learn(_files(spark, f"{folder}/in", data, 30), made("single"), store, "i", "y", f"{folder}/c", 1).awaitTermination()
    assert [r.pred for r in store.rows().orderBy("idx").collect()] == want
    assert made("single").restored(store.latest()[2]).sizes() == [slow.tree.sizes()]


def test_empty_store(spark):
    store = models.Store(spark, fresh_folder(spark, "none"))
    assert store.latest() == (-1, -1, None) and store.rows().count() == 0
    assert not math.isfinite(Forest(["a", "b"], ["x"]).trees[0].criterion(np.zeros(2), []))
