"""Hoeffding trees and ensembles of them over a table or stream that is not dealt by key.

All models learn together.  For a micro-batch one Arrow pass walks every model's tree (sent out once, no larger than
`models` x `max_leaves` leaves), predicts each row before it is learned, weighs it for each model, and sums up
one statistics cube (model, leaf, attribute, class) for its partition.  One grouped aggregate merges the partitions'
cubes, whatever the number of models, and only its result reaches the driver, where leaves past their grace period may split.
So a batch costs one pass over its rows and a shuffle of cubes; rows never move.

Within a batch the models are fixed.  With batches of one row everything is as row by row: Poisson weights of online
bagging are drawn by row and model; in boosting a row's rate is what the models before it make of it, each by its sums before
the batch and the row itself; an adaptive ensemble feeds each model's detector with its share of errors in runs of
`pace` of the order (one step a batch without it) and plants a fallen model anew after the batch.

Missing values (null, NaN) are left out of statistics and follow the heaviest branch; rows without a class are predicted and
not learned; votes that agree to nine digits are a tie, which goes to the first class.  A nominal attribute of more than
`max_values` values in a leaf is refused, as its counts would not be bounded.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_uniform

from .drift import Detector
from .hoeffding import HoeffdingTree, Node, info_gain

#: What a batch's pass gives: predictions (part row), and cells of the cube (part cube) by partition.
PASSED = "part string, idx long, y int, pred int, model int, leaf long, attribute string, value string, cls int, n double, s double, q double, low double, high double"
_NAMES = [c.split()[0] for c in PASSED.split(", ")]
#: Attributes of the cube that are no columns: class counts of a leaf, rates of a model (class 1: right), errors of a model by run.
COUNTS, RATES, ERRORS = "#counts", "#rates", "#errors"


class Columns:
    """Attribute columns of a batch of rows: numbers, or codes into a list of values (-1: missing)."""

    def __init__(self, batch: pa.RecordBatch, numeric: list[str], nominal: list[str]):
        self.rows = batch.num_rows
        self.numbers = {a: batch.column(a).to_numpy(zero_copy_only=False).astype(float) for a in numeric}
        self.codes: dict[str, np.ndarray] = {}
        self.values: dict[str, list[str]] = {}
        for a in nominal:
            coded = batch.column(a).dictionary_encode()
            self.codes[a] = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            self.values[a] = coded.dictionary.to_pylist()


def leaves_of(root: Node, x: Columns) -> np.ndarray:
    """The number of the leaf that each row reaches."""
    out, stack = np.empty(x.rows, np.int64), [(root, np.arange(x.rows))]
    while stack:
        node, at = stack.pop()
        if not node.children:
            out[at] = node.id
            continue
        heavy = int(np.argmax([c.counts.sum() for c in node.children]))
        if node.cut is not None:
            v = x.numbers[node.attribute][at]
            child = np.where(np.isnan(v), heavy, (v > node.cut).astype(np.int64))
        else:
            code, last = x.codes[node.attribute][at], len(node.children) - 1
            branch = {v: k for k, v in enumerate(node.values)}
            other = last if last + 1 > len(node.values) else heavy
            by_code = np.array([*(branch.get(v, other) for v in x.values[node.attribute]), heavy], np.int64)
            child = by_code[code]
        for k, c in enumerate(node.children):
            below = at[child == k]
            if len(below):
                stack.append((c, below))
    return out


def poisson(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion; normal ones, rounded, for rates of 100 and more (as `ensembles.poisson_sample`)."""
    out, term = np.zeros(len(u)), np.exp(-np.minimum(rate, 100.0))
    total, open_ = term.copy(), (rate > 0) & (rate < 100)
    open_ &= total <= u
    k = 0
    while open_.any() and k < 1000:
        k += 1
        term = term * (rate / k)
        total = np.where(open_, total + term, total)
        out[open_] = k
        open_ &= total <= u
    large = rate >= 100
    if large.any():
        v, r = np.maximum(u[large], 1e-12), rate[large]
        out[large] = np.maximum(0, np.round(r + np.sqrt(r) * np.sqrt(-2 * np.log(v)) * np.cos(2 * math.pi * u[large])))
    return out


class _Cube:
    """Sums of a partition by model, leaf, attribute and class."""

    def __init__(self, classes: int, limit: int):
        self.classes, self.limit, self.cells = classes, limit, {}

    def add(self, key: tuple, n: float, s: float = 0.0, q: float = 0.0, low: float = math.inf, high: float = -math.inf) -> None:
        old = self.cells.get(key)
        self.cells[key] = [n, s, q, low, high] if old is None else [old[0] + n, old[1] + s, old[2] + q, min(old[3], low), max(old[4], high)]

    def learn(self, model: int, leaf: np.ndarray, x: Columns, y: np.ndarray, weight: np.ndarray) -> None:
        ids, at = np.unique(leaf, return_inverse=True)
        cell = at * self.classes + y
        size = len(ids) * self.classes
        names = [(int(i), c) for i in ids for c in range(self.classes)]
        for j in np.flatnonzero(count := np.bincount(cell, weight, size)):
            self.add((model, names[j][0], COUNTS, None, names[j][1]), count[j])
        for a, v in x.numbers.items():
            known = ~np.isnan(v)
            c, w, v = cell[known], weight[known], v[known]
            n, s, q = (np.bincount(c, z, size) for z in (w, w * v, w * v * v))
            low, high = np.full(size, math.inf), np.full(size, -math.inf)
            np.minimum.at(low, c, v)
            np.maximum.at(high, c, v)
            for j in np.flatnonzero(n):
                self.add((model, names[j][0], a, None, names[j][1]), n[j], s[j], q[j], low[j], high[j])
        for a, code in x.codes.items():
            known, values = code >= 0, x.values[a]
            pairs, inverse = np.unique(cell[known] * max(len(values), 1) + code[known], return_inverse=True)
            for j, n in zip(pairs.tolist(), np.bincount(inverse, weight[known], len(pairs)).tolist()):
                leaf_id, cls = names[j // len(values)]
                self.add((model, leaf_id, a, values[j % len(values)], cls), n)

    def batch(self) -> pa.RecordBatch:
        keys, sums = list(self.cells), np.array(list(self.cells.values()), float).reshape(-1, 5)
        n = len(keys)
        model, leaf, attribute, value, cls = zip(*keys) if keys else ((),) * 5
        none = lambda kind: pa.nulls(n, kind)
        arrays = [pa.array(["cube"] * n, pa.string()), none(pa.int64()), none(pa.int32()), none(pa.int32()), pa.array(model, pa.int32()), pa.array(leaf, pa.int64()), pa.array(attribute, pa.string()), pa.array(value, pa.string()), pa.array(cls, pa.int32())]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array(sums[:, k]) for k in range(5))], _NAMES)


class Forest:
    """Trees that learn the same stream: kind is single (one tree), bagging, adaptive (bagging) or boosting."""

    def __init__(self, classes: list[str], numeric: list[str] = (), nominal: list[str] = (), models: int = 1, kind: str = "single", detector: Detector | None = None, pace: int | None = None, max_values: int = 1000, **options):
        if kind not in ("single", "bagging", "adaptive", "boosting") or (kind == "single") != (models == 1) or (kind == "adaptive") != (detector is not None):
            raise ValueError("kind, models and detector do not go together")
        self.classes, self.numeric, self.nominal, self.kind, self.pace, self.max_values = list(classes), list(numeric), list(nominal), kind, pace, max_values
        self.detector, self.options = detector, options
        self.trees = [self._plant() for _ in range(models)]
        self.right, self.wrong = [0.0] * models, [0.0] * models
        self.states, self.estimates, self.resets = [list(detector.init) if detector else [] for _ in range(models)], [0.0] * models, [0] * models

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.nominal]

    def _plant(self) -> HoeffdingTree:
        return HoeffdingTree(self.classes, self.numeric, self.nominal, **self.options)

    # ---- one batch of rows, in a task

    def _weights(self) -> np.ndarray:
        """What each model's vote counts."""
        if self.kind != "boosting":
            return np.ones(len(self.trees))
        right, wrong = np.array(self.right), np.array(self.wrong)
        e = wrong / np.maximum(right + wrong, 1e-300)
        return np.where((e > 0) & (e <= 0.5), np.log((1 - e) / np.where(e > 0, e, 1)), 0.0)

    def passed(self, batches: Iterator[pa.RecordBatch], learning: bool = True) -> Iterator[pa.RecordBatch]:
        """Predictions of all rows (idx, y, draws, attributes), and at the end the cube of those with a class."""
        cube, size, weights = _Cube(len(self.classes), self.max_values), len(self.classes), self._weights()
        tables = [{n.id: n.counts for n in t.leaves()} for t in self.trees]
        for batch in batches:
            x, n = Columns(batch, self.numeric, self.nominal), batch.num_rows
            y = batch.column("y").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            idx = batch.column("idx").to_numpy(zero_copy_only=False)
            draws = batch.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if self.kind != "single" else None
            leaves, own, votes = [], [], np.zeros((n, size))
            for tree, table, weight in zip(self.trees, tables, weights):
                leaf = leaves_of(tree.root, x)
                ids, at = np.unique(leaf, return_inverse=True)
                counts = np.array([table[i] for i in ids.tolist()]).reshape(-1, size)
                total = counts.sum(1, keepdims=True)
                votes += weight * np.where(total > 0, counts / np.where(total > 0, total, 1), 0.0)[at]
                leaves.append(leaf)
                own.append(counts.argmax(1)[at])
            pred = np.round(votes, 9).argmax(1) if self.kind != "single" else own[0]
            none = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(["row"] * n, pa.string()), batch.column("idx"), batch.column("y"), pa.array(pred, pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.string()), none(pa.string()), none(pa.int32()), *(none(pa.float64()) for _ in range(5))], _NAMES)
            there = y >= 0
            if not learning or not there.any():
                continue
            rate = np.ones(n)
            for k, (leaf, guess) in enumerate(zip(leaves, own)):
                hit = guess == y
                if self.kind == "single":
                    weight = np.ones(n)
                else:
                    weight = poisson(draws[:, k], rate)
                if self.kind == "boosting":
                    for right in (0, 1):
                        of = there & (hit == bool(right))
                        if of.any():
                            cube.add((k, 0, RATES, None, right), float(rate[of].sum()))
                    seen = self.right[k] + self.wrong[k] + rate
                    rate = rate * seen / (2 * np.where(hit, self.right[k] + rate, self.wrong[k] + rate))
                elif self.kind == "adaptive":
                    runs = idx // self.pace if self.pace else np.zeros(n, np.int64)
                    which, at = np.unique(runs[there], return_inverse=True)
                    for r, rows, missed in zip(which.tolist(), np.bincount(at).tolist(), np.bincount(at, ~hit[there]).tolist()):
                        cube.add((k, int(r), ERRORS, None, 0), rows, missed)
                learned = there & (weight > 0)
                if learned.any():
                    part = batch.filter(pa.array(learned))
                    cube.learn(k, leaf[learned], Columns(part, self.numeric, self.nominal), y[learned], weight[learned])
        if learning:
            yield cube.batch()

    # ---- a batch of a table

    def _sent(self, spark):
        """What tasks need of this forest, sent out: all but the detector."""
        out = copy.copy(self)
        out.detector, out.states = None, []
        return spark.sparkContext.broadcast(out)

    def prepared(self, df: DataFrame, order: str, y: str) -> DataFrame:
        """idx, y (the number of the class; other values are null), draws, attributes."""
        number = F.when(F.col(y).isNull(), None)
        for k, c in enumerate(self.classes):
            number = number.when(F.col(y).cast("string") == c, k)
        draws = [F.array(*(hash_uniform(F.col(order).cast("string"), F.lit(str(k))) for k in range(len(self.trees)))).alias("draws")] if self.kind != "single" else []
        return df.select(F.col(order).cast("long").alias("idx"), number.cast("int").alias("y"), *draws, *(F.col(a).cast("double").alias(a) for a in self.numeric), *(F.col(a).cast("string").alias(a) for a in self.nominal))

    def predict(self, df: DataFrame, order: str, y: str) -> DataFrame:
        """idx, y, pred (numbers of classes) by the models as they are."""
        held = self._sent(df.sparkSession)
        return self.prepared(df, order, y).mapInArrow(lambda batches: held.value.passed(batches, False), PASSED).select("idx", "y", "pred")

    def test_then_learn(self, df: DataFrame, order: str, y: str, folder: str) -> Forest:
        """Writes the predictions of a batch to `folder`, as part=row, and learns it."""
        spark = df.sparkSession
        held = self._sent(spark)
        self.prepared(df, order, y).mapInArrow(lambda batches: held.value.passed(batches), PASSED).write.partitionBy("part").parquet(folder)
        held.unpersist()
        cube = spark.read.schema(PASSED).parquet(folder).where("part = 'cube'")
        sums = cube.groupBy("model", "leaf", "attribute", "value", "cls").agg(*(F.sum(c).alias(c) for c in "nsq"), F.min("low").alias("low"), F.max("high").alias("high"))
        return self.learn(sums.collect())

    def learn(self, cells) -> Forest:
        """Takes up the merged cube of a batch: what a leaf has seen, which leaves split, what becomes of weights and detectors."""
        cells = sorted(cells, key=lambda r: (r["model"], r["leaf"], r["attribute"], r["value"] or "", r["cls"]))
        at = [{n.id: n for n in t.leaves()} for t in self.trees]
        errors: list[list[tuple[float, float]]] = [[] for _ in self.trees]
        for r in cells:
            k, a, c = r["model"], r["attribute"], r["cls"]
            if a == RATES:
                (self.right if c else self.wrong)[k] += r["n"]
            elif a == ERRORS:
                errors[k].append((r["n"], r["s"]))
            elif a == COUNTS:
                at[k][r["leaf"]].counts[c] += r["n"]
                at[k][r["leaf"]].seen += r["n"]
            elif r["value"] is not None:
                by = at[k][r["leaf"]].nominal.setdefault(a, {})
                by.setdefault(r["value"], np.zeros(len(self.classes)))[c] += r["n"]
                if len(by) > self.max_values:
                    raise ValueError(f"{a} has more than {self.max_values} values in a leaf")
            else:
                s = at[k][r["leaf"]].numeric.setdefault(a, np.tile([0.0, 0.0, 0.0, np.inf, -np.inf], (len(self.classes), 1)))[c]
                s[:3] += (r["n"], r["s"], r["q"])
                s[3], s[4] = min(s[3], r["low"]), max(s[4], r["high"])
        for tree, nodes in zip(self.trees, at):
            for n in nodes.values():
                tree.check(n)
        if self.detector:
            for k, found in enumerate(errors):
                self._watch(k, found)
        return self

    def _watch(self, k: int, found: list[tuple[float, float]]) -> None:
        """Steps of a model's detector, in order; after one that sees its errors rise the model starts anew."""
        fallen = False
        for n, missed in found:
            self.states[k], change, _, estimate = self.detector.step(self.states[k], missed / n)
            fallen |= bool(change and estimate > self.estimates[k])
            self.estimates[k] = estimate
        if fallen:
            self.trees[k], self.states[k], self.estimates[k] = self._plant(), list(self.detector.init), 0.0
            self.resets[k] += 1

    def sizes(self) -> list[dict[str, int]]:
        return [t.sizes() for t in self.trees]

    # ---- as text, for a store

    def to_json(self) -> str:
        return json.dumps({"right": self.right, "wrong": self.wrong, "states": self.states, "estimates": self.estimates, "resets": self.resets, "trees": [{"made": t.made, "root": _told(t.root)} for t in self.trees]})

    def restored(self, text: str) -> Forest:
        """This forest with the state that `to_json` gave."""
        told = json.loads(text)
        for name in ("right", "wrong", "states", "estimates", "resets"):
            setattr(self, name, told[name])
        self.trees = [self._plant() for _ in told["trees"]]
        for tree, t in zip(self.trees, told["trees"]):
            tree.made, tree.root = t["made"], _node(t["root"])
            tree.splits = tree.made - len(tree.leaves())
        return self


def _told(n: Node) -> dict:
    numbers = {a: [[v if math.isfinite(v) else None for v in row] for row in s.tolist()] for a, s in n.numeric.items()}
    nominal = {a: {v: w.tolist() for v, w in by.items()} for a, by in n.nominal.items()}
    return {"id": n.id, "counts": n.counts.tolist(), "depth": n.depth, "seen": n.seen, "checked": n.checked, "numeric": numbers, "nominal": nominal, "attribute": n.attribute, "cut": n.cut, "values": n.values, "children": [_told(c) for c in n.children]}


def _node(t: dict) -> Node:
    bounds = (0.0, 0.0, 0.0, math.inf, -math.inf)
    numbers = {a: np.array([[b if v is None else v for v, b in zip(row, bounds)] for row in s]) for a, s in t["numeric"].items()}
    nominal = {a: {v: np.array(w) for v, w in by.items()} for a, by in t["nominal"].items()}
    return Node(t["id"], np.array(t["counts"]), t["depth"], t["seen"], t["checked"], numbers, nominal, t["attribute"], t["cut"], t["values"], [_node(c) for c in t["children"]])


def batched(df: DataFrame, model, order: str, y: str, batches: int, folder: str, number: Column | None = None) -> None:
    """Test-then-learn of a model (`Forest`, or anything of its shape) over micro-batches of a table: predictions go to `folder`/rows/batch=k.

    `number` gives a row's batch (0 to batches - 1); without it these are equal stretches of the order.  The rows are
    written once by batch under `folder`, so that a batch reads no more than its own.
    """
    spark = df.sparkSession
    if number is None:
        low, high = df.agg(F.min(order), F.max(order)).first()
        width = -(-((high or 0) - (low or 0) + 1) // batches)
        number = F.floor((F.col(order) - (low or 0)) / width)
    columns = list(dict.fromkeys([order, y, *model.columns]))
    cut = df.where(F.col(order).isNotNull()).select(*columns, number.cast("int").alias("_batch"))
    cut.write.partitionBy("_batch").parquet(f"{folder}/input")
    given = spark.read.schema(cut.schema).parquet(f"{folder}/input")
    for k in range(batches):
        model.test_then_learn(given.where(F.col("_batch") == k).select(columns), order, y, f"{folder}/rows/batch={k}")


def prequential(df: DataFrame, forest: Forest, order: str, y: str, batches: int, folder: str, number: Column | None = None) -> DataFrame:
    """`batched`, and what it predicted: batch, idx, y, pred."""
    batched(df, forest, order, y, batches, folder, number)
    return df.sparkSession.read.schema(f"{PASSED}, batch int").parquet(f"{folder}/rows").where("part = 'row'").select("batch", "idx", "y", "pred")
