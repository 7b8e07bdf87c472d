"""Learners that take one row after the other, for streams that are dealt by key.

A learner gives a vote per class (or one number) for a row, and learns a row; `prequential_by` folds rows
of a key through one learner, in order, test first.  Ensembles and drift resets work over any of them.
Rows are dicts of attribute values; a missing value (None or NaN) is left out of statistics and, in a tree,
follows the heaviest branch.  Models that must see a whole unkeyed stream are micro-batch loops instead
(`hoeffding`, `rules.AMRules`).
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drift import Detector, ph_test
from .ensembles import poisson_sample
from .ensembles import _uniform as uniform
from .hoeffding import HoeffdingTree, Node
from .observers import LimitedMoments
from .rules import ABOVE, AT_MOST, Perceptron, Rule


def _there(v) -> bool:
    return v is not None and v == v


class Majority:
    """Votes are the class weights seen."""

    def __init__(self, classes: int):
        self.counts = [0.0] * classes

    def votes(self, x: dict) -> list[float]:
        return list(self.counts)

    def learn(self, x: dict, y: int, weight: float = 1.0) -> None:
        self.counts[y] += weight


class NaiveBayes:
    """Class priors times Gaussian densities (numbers) and shares (everything else), by weighted moments."""

    def __init__(self, classes: int):
        self.counts = [0.0] * classes
        self.moments: dict[str, list[list[float]]] = {}
        self.shares: dict[str, list[dict]] = {}

    def votes(self, x: dict) -> list[float]:
        total = sum(self.counts)
        out = [c / total if total else 0.0 for c in self.counts]
        for a, v in x.items():
            if not _there(v):
                continue
            for c, w in enumerate(self.counts):
                if w <= 0:
                    continue
                if a in self.moments:
                    n, mean, m2 = self.moments[a][c]
                    var = m2 / (n - 1) if n > 1 else 0.0
                    out[c] *= math.exp(-((v - mean) ** 2) / (2 * var)) / math.sqrt(2 * math.pi * var) if var > 0 else float(v == mean)
                elif a in self.shares:
                    seen = self.shares[a][c]
                    out[c] *= seen.get(v, 0.0) / (sum(seen.values()) or 1.0)
        return out

    def learn(self, x: dict, y: int, weight: float = 1.0) -> None:
        self.counts[y] += weight
        for a, v in x.items():
            if not _there(v) or weight <= 0:
                continue
            if isinstance(v, str):
                seen = self.shares.setdefault(a, [{} for _ in self.counts])[y]
                seen[v] = seen.get(v, 0.0) + weight
            else:
                m = self.moments.setdefault(a, [[0.0, 0.0, 0.0] for _ in self.counts])[y]
                m[0] += weight
                step = v - m[1]
                m[1] += weight * step / m[0]
                m[2] += weight * step * (v - m[1])


class Tree:
    """A Hoeffding tree that checks a leaf as soon as its grace period is over, row by row."""

    def __init__(self, classes: int, **options):
        self.tree = HoeffdingTree([str(c) for c in range(classes)], [], **options)

    def _leaf(self, x: dict) -> Node:
        n = self.tree.root
        while n.children:
            v = x.get(n.attribute)
            if not _there(v):
                n = max(n.children, key=lambda c: c.counts.sum())
            elif n.cut is not None:
                n = n.children[0 if v <= n.cut else 1]
            elif str(v) in n.values:
                n = n.children[n.values.index(str(v))]
            else:
                n = n.children[-1] if len(n.children) > len(n.values) else max(n.children, key=lambda c: c.counts.sum())
        return n

    def votes(self, x: dict) -> list[float]:
        return self._leaf(x).counts.tolist()

    def learn(self, x: dict, y: int, weight: float = 1.0) -> None:
        if weight <= 0:
            return
        n, classes = self._leaf(x), len(self.tree.classes)
        n.counts[y] += weight
        n.seen += weight
        for a, v in x.items():
            if not _there(v):
                continue
            if isinstance(v, str):
                n.nominal.setdefault(a, {}).setdefault(v, np.zeros(classes))[y] += weight
            else:
                held = n.numeric.get(a)
                if held is None:
                    held = n.numeric[a] = [[0.0, 0.0, 0.0, math.inf, -math.inf] for _ in range(classes)]
                s = held[y]
                s[0] += weight
                s[1] += weight * v
                s[2] += weight * v * v
                if v < s[3]:
                    s[3] = v
                if v > s[4]:
                    s[4] = v
        if self.tree.due(n):
            # lists for a row's few numbers, arrays for the check
            n.numeric = {a: np.array(held) for a, held in n.numeric.items()}
            self.tree.check(n)
            n.numeric = {a: held.tolist() for a, held in n.numeric.items()}


class Adaptive:
    """A learner with a detector on its errors, which starts anew when the detector sees them rise."""

    def __init__(self, make: Callable[[], object], detector: Detector):
        self.make, self.detector, self.resets = make, detector, 0
        self._start()

    def _start(self) -> None:
        self.learner, self.state, self.estimate = self.make(), list(self.detector.init), 0.0

    def votes(self, x: dict) -> list[float]:
        return self.learner.votes(x)

    def learn(self, x: dict, y: int, weight: float = 1.0) -> None:
        votes = self.learner.votes(x)
        self.learner.learn(x, y, weight)
        self.state, change, _, estimate = self.detector.step(self.state, float(votes.index(max(votes)) != y))
        if change and estimate > self.estimate:
            self.resets += 1
            self._start()
        else:
            self.estimate = estimate


def _share(votes: list[float], weight: float, out: list[float]) -> None:
    total = sum(votes)
    if total > 0:
        for c, v in enumerate(votes):
            out[c] += weight * v / total


class Bagging:
    """Poisson(1) weights for each of several learners; votes made to sum to one are added up."""

    def __init__(self, make: Callable[[], object], models: int, classes: int, draw: Callable[[int, int], float] = uniform):
        self.learners, self.classes, self.draw, self.seen = [make() for _ in range(models)], classes, draw, 0

    def votes(self, x: dict) -> list[float]:
        out = [0.0] * self.classes
        for m in self.learners:
            _share(m.votes(x), 1.0, out)
        return out

    def learn(self, x: dict, y: int, weight: float = 1.0) -> None:
        for k, m in enumerate(self.learners):
            times = poisson_sample(self.draw(self.seen, k), 1.0)
            if times:
                m.learn(x, y, weight * times)
        self.seen += 1


class Boosting:
    """Learners whose rate for a row grows with every learner before that it fools; votes weigh log((1 - e) / e)."""

    def __init__(self, make: Callable[[], object], models: int, classes: int, draw: Callable[[int, int], float] = uniform):
        self.learners, self.classes, self.draw, self.count = [make() for _ in range(models)], classes, draw, 0
        self.right, self.wrong, self.seen = [0.0] * models, [0.0] * models, [0.0] * models

    def votes(self, x: dict) -> list[float]:
        out = [0.0] * self.classes
        for m, right, wrong in zip(self.learners, self.right, self.wrong):
            e = wrong / (right + wrong) if right + wrong else 0.0
            if 0 < e <= 0.5:
                _share(m.votes(x), math.log((1 - e) / e), out)
        return out

    def learn(self, x: dict, y: int, weight: float = 1.0) -> None:
        rate = weight
        for k, m in enumerate(self.learners):
            votes = m.votes(x)
            hit = votes.index(max(votes)) == y
            times = poisson_sample(self.draw(self.count, k), rate)
            if times:
                m.learn(x, y, float(times))
            self.seen[k] += rate
            if hit:
                self.right[k] += rate
                rate *= self.seen[k] / (2 * self.right[k])
            else:
                self.wrong[k] += rate
                rate *= self.seen[k] / (2 * self.wrong[k])
        self.count += 1


class Mean:
    """The mean target, with a faded mean of its own errors."""

    def __init__(self, fade: float = 0.99, n: float = 0.0, mean: float = 0.0):
        self.fade, self.n, self.total, self.missed, self.seen = fade, n, n * mean, 0.0, 0.0

    def predict(self) -> float:
        return self.total / self.n if self.n else 0.0

    def learn(self, y: float) -> None:
        self.missed = abs(self.predict() - y) + self.fade * self.missed
        self.seen = 1 + self.fade * self.seen
        self.n += 1
        self.total += y

    @property
    def error(self) -> float:
        return self.missed / self.seen if self.seen else math.inf


class RuleNode:
    """What a rule knows of the rows it covers: two predictors, the target's moments, a summary per attribute, a change test."""

    def __init__(self, attributes: list[str], mean: Mean | None = None, predictor: str = "adaptive", points: int = 50):
        self.attributes, self.predictor, self.n = attributes, predictor, 0
        self.sums = [0.0, 0.0, 0.0]
        self.perceptron, self.mean = Perceptron(len(attributes)), mean or Mean()
        self.summaries = [LimitedMoments(points) for _ in attributes]
        self.test = ph_test(fade=0.99)
        self.state = list(self.test.init)

    def _linear(self) -> bool:
        """The perceptron where its error is the lower."""
        return self.predictor == "perceptron" or self.predictor == "adaptive" and self.perceptron.faded_error < self.mean.error

    def predict(self, x: list[float]) -> float:
        return self.perceptron.predict(x) if self._linear() else self.mean.predict()

    @property
    def error(self) -> float:
        return min(self.perceptron.faded_error, self.mean.error)

    def deviates(self, x: list[float], univariate: float = 0.1, multivariate: float = 0.99, least: int = 30) -> bool:
        """Whether a row is an anomaly: its improbable attributes make up nearly all of its log improbability."""
        if self.perceptron.n < least:
            return False
        total = odd = 0.0
        for v, (mean, sd) in zip(x, self.perceptron.stats):
            if sd > 0 and v == v:
                p = 1 / (1 + ((v - mean) / sd) ** 2)
                log = abs(math.log(p))
                total += log
                odd += log if p < univariate else 0.0
        return total > 0 and odd / total >= multivariate

    def changed(self, x: list[float], y: float) -> bool:
        """One step of the change test on the row's normalised error."""
        n, s, q = self.sums
        sd = math.sqrt(max(q - s * s / n, 0) / (n - 1)) if n > 1 else 0.0
        scale = sd if sd > 1e-7 else math.inf
        self.state, change, _, _ = self.test.step(self.state, abs(y - self.predict(x)) / scale)
        return change

    def learn(self, x: list[float], y: float) -> None:
        self.n += 1
        self.sums[0] += 1
        self.sums[1] += y
        self.sums[2] += y * y
        for v, summary in zip(x, self.summaries):
            summary.add(v, y)
        self.perceptron.learn(x, y)
        self.mean.learn(y)

    def expansion(self, delta: float, tie: float):
        """(attribute, operator, cut, sums of the better branch, of the other), if the best cut is good enough."""
        sd = lambda s: math.sqrt(max(s[2] - s[1] ** 2 / s[0], 0) / s[0]) if s[0] > 0 else 0.0
        best = []
        for a, summary in zip(self.attributes, self.summaries):
            found = []
            for cut, below, above in summary.cuts():
                n = below[0] + above[0]
                if min(below[0], above[0]) >= 0.05 * n:
                    found.append((sd(below + above) - below[0] / n * sd(below) - above[0] / n * sd(above), cut, below, above))
            if found:
                merit, cut, below, above = max(found, key=lambda f: (f[0], -f[1]))
                best.append((merit, a, cut, below, above))
        best.sort(key=lambda b: -b[0])
        if not best or best[0][0] <= 0:
            return None
        bound = math.sqrt(math.log(1 / delta) / (2 * self.n))
        if len(best) > 1 and not (best[1][0] / best[0][0] + bound < 1 or bound < tie):
            return None
        _, a, cut, below, above = best[0]
        low = sd(below) <= sd(above)
        return a, AT_MOST if low else ABOVE, cut, *((below, above) if low else (above, below))


class Rules:
    """Adaptive model rules for regression, row by row.

    A row goes to the first rule that covers it (or, unordered, to all); one that deviates is not learned there.  A
    rule goes when its change test says so, and takes on a literal when the best cut is sure enough.  Rows that no
    rule covers teach the default rule, which becomes a rule when it expands and leaves a new default behind.
    """

    def __init__(self, attributes: list[str], grace: int = 200, delta: float = 1e-7, tie: float = 0.05, ordered: bool = True, predictor: str = "adaptive", anomalies: bool = True):
        self.attributes, self.grace, self.delta, self.tie = list(attributes), grace, delta, tie
        self.ordered, self.predictor, self.anomalies = ordered, predictor, anomalies
        self.rules: list[tuple[Rule, RuleNode]] = []
        self.default = self._node()
        self.dropped = 0
        self._tests: list[tuple] | None = None  # made anew when rules have changed

    def _node(self, mean: Mean | None = None) -> RuleNode:
        return RuleNode(self.attributes, mean, self.predictor)

    def _row(self, x: dict) -> list[float]:
        return [math.nan if not _there(x.get(a)) else float(x[a]) for a in self.attributes]

    def _covering(self, row: list[float]) -> list[int]:
        if self._tests is None:
            self._tests = self._indexed()
        hits = (1 << len(self.rules)) - 1
        for at, operator, cuts, masks, free in self._tests:
            v = row[at]
            hits &= masks[bisect.bisect_left(cuts, v)] if v == v else free
        if not hits:
            return [-1]
        first = (hits & -hits).bit_length() - 1
        return [first] if self.ordered else [k for k in range(first, len(self.rules)) if hits >> k & 1]

    def _indexed(self) -> list[tuple]:
        """Of each attribute and operator: the cuts in order, and the rules, as bits, that a value between two of them passes."""
        out = []
        for at, a in enumerate(self.attributes):
            for operator in (AT_MOST, ABOVE):
                tests = sorted((v, k) for k, (rule, _) in enumerate(self.rules) for name, o, v in rule.literals if name == a and (o == AT_MOST) == (operator == AT_MOST))
                if tests:
                    failed, masks = 0, []
                    for _, k in tests if operator == AT_MOST else reversed(tests):
                        masks.append(failed)
                        failed |= 1 << k
                    masks.append(failed)
                    every = (1 << len(self.rules)) - 1
                    masks = [every & ~m for m in (masks if operator == AT_MOST else reversed(masks))]
                    out.append((at, operator, [v for v, _ in tests], masks, every & ~failed))
        return out

    def votes(self, x: dict) -> list[float]:
        """The prediction: weighted by inverse error where several rules cover the row."""
        row = self._row(x)
        nodes = [self.rules[k][1] if k >= 0 else self.default for k in self._covering(row)]
        known = [(n.predict(row), 1 / (n.error + 1e-9)) for n in nodes if math.isfinite(n.error)]
        if not known:
            return [sum(n.predict(row) for n in nodes) / len(nodes)]
        return [sum(p * w for p, w in known) / sum(w for _, w in known)]

    def learn(self, x: dict, y: float, weight: float = 1.0) -> None:
        """A weight is how often the row is learned, as online bagging has it; it is a whole number."""
        if weight != int(weight) or weight < 0:
            raise ValueError(f"a weight of {weight} is no number of times")
        for _ in range(int(weight) if _there(y) else 0):
            self._learn(x, y)

    def _learn(self, x: dict, y: float) -> None:
        row, gone = self._row(x), []
        for k in self._covering(row):
            if k < 0:
                self.default.learn(row, y)
                if self.default.n % self.grace == 0:
                    self._new_rule()
                continue
            rule, node = self.rules[k]
            if self.anomalies and node.deviates(row):
                continue
            if node.changed(row, y):
                gone.append(k)
                continue
            node.learn(row, y)
            if node.n % self.grace == 0:
                found = node.expansion(self.delta, self.tie)
                if found:
                    a, operator, cut, own, _ = found
                    if rule.add(a, operator, cut):
                        self.rules[k] = rule, self._node(Mean(n=own[0], mean=own[1] / own[0]))
                        self._tests = None
        if gone:
            self.rules = [r for k, r in enumerate(self.rules) if k not in gone]
            self.dropped += len(gone)
            self._tests = None

    def _new_rule(self) -> None:
        found = self.default.expansion(self.delta, self.tie)
        if found:
            a, operator, cut, own, other = found
            self.rules.append((Rule([(a, operator, cut)]), self._node(Mean(n=own[0], mean=own[1] / own[0]))))
            self.default = self._node(Mean(n=other[0], mean=other[1] / other[0]))
            self._tests = None


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Dealt by key to many partitions: a learner's key is much work in few bytes, by which partitions would be merged."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism), key)


def prequential_by(df: DataFrame, key: str, order: str, x: list[str], y: str, make: Callable[[], object], classes: int = 0) -> DataFrame:
    """Test-then-train of one learner a key: key, order, y, pred (a class number, or a number if `classes` is 0).

    Rows without a target are predicted and not learned.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    dealt = by_key(df.select(key, order, y, *x), key).sortWithinPartitions(key, order)

    def run(batches):
        last, learner = object(), None
        for batch in batches:
            keys, targets, columns = batch.column(0).to_pylist(), batch.column(2).to_pylist(), [batch.column(3 + k).to_pylist() for k in range(len(x))]
            out = []
            for at, (k, target) in enumerate(zip(keys, targets)):
                if learner is None or k != last:
                    last, learner = k, make()
                row = {a: c[at] for a, c in zip(x, columns)}
                votes = learner.votes(row)
                out.append(votes.index(max(votes)) if classes else votes[0])
                if target is not None and target == target:
                    learner.learn(row, target)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int32() if classes else pa.float64())], [key, order, y, "pred"])

    return dealt.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {y} {kinds[y]}, pred {'int' if classes else 'double'}")


def hits(out: DataFrame, key: str, y: str) -> DataFrame:
    """Rows and right predictions of each key."""
    return out.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(F.col("pred") == F.col(y), 1)).alias("hits"))
