"""Adaptive model rules: coverage, votes, anomaly test, and the learner as a micro-batch loop."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Literals compare by 0 equal, 1 at most, 2 above.
EQUAL, AT_MOST, ABOVE = 0, 1, 2


def literal(attribute: str, operator: int, value: float) -> Column:
    c = F.col(attribute)
    return c == value if operator == EQUAL else c <= value if operator == AT_MOST else c > value


def binary_branch(c: Column, cut: float, equal_passes: bool = True) -> Column:
    """0 below the cut (or at it), 1 above, -1 for a missing value."""
    return F.when(c.isNull(), -1).when((c <= cut) if equal_passes else (c < cut), 0).otherwise(1)


def nominal_branch(c: Column, value) -> Column:
    return F.when(c.isNull(), -1).when(c == value, 0).otherwise(1)


def describe(attribute: str, operator: int, value) -> str:
    return f"{attribute} {('=', '<=', '>')[operator]} {value}"


@dataclass
class Rule:
    """A conjunction of literals; none covers everything."""

    literals: list[tuple[str, int, float]] = field(default_factory=list)

    def covers(self) -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & literal(*x)
        return F.coalesce(out, F.lit(False))

    def add(self, attribute: str, operator: int, value: float) -> bool:
        """Tighten the literal of the same attribute and operator, or append one; whether anything changed."""
        for k, (a, o, v) in enumerate(self.literals):
            if (a, o) == (attribute, operator):
                tighter = value < v if o == AT_MOST else value > v if o == ABOVE else False
                if tighter:
                    self.literals[k] = (a, o, value)
                return tighter
        self.literals.append((attribute, operator, value))
        return True

    def __str__(self) -> str:
        return " and ".join(describe(*x) for x in self.literals) or "always"


def tightened(literals: DataFrame) -> DataFrame:
    """A rules table (rule, attribute, operator, value) with one literal per attribute and operator."""
    return literals.groupBy("rule", "attribute", "operator").agg(F.when(F.col("operator") == AT_MOST, F.min("value")).otherwise(F.max("value")).alias("value"))


def first_cover(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row; -1 for none."""
    out = F.lit(-1)
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(rules[k].covers(), k).otherwise(out)
    return out


def all_covers(rules: list[Rule]) -> Column:
    """Numbers of all rules that cover a row."""
    return F.array_compact(F.array(*(F.when(r.covers(), k) for k, r in enumerate(rules))))


def anomaly(x: list[Column], mean: list[Column], sd: list[Column], least: float = 0.10) -> Column:
    """Share of the surprise that comes from attributes whose Cantelli bound 1 / (1 + k^2) is below `least`."""
    odd, all_ = F.lit(0.0), F.lit(0.0)
    for v, m, s in zip(x, mean, sd):
        k = F.abs(v - m) / s
        p = 1 / (1 + k * k)
        log = F.when(s > 0, F.abs(F.log(p))).otherwise(0.0)
        all_ += log
        odd += F.when(p < least, log).otherwise(0.0)
    return F.when(all_ > 0, odd / all_).otherwise(0.0)


def normalized_error(y: Column, pred: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 1e-7, F.abs((y - mean) / sd - (pred - mean) / sd)).otherwise(F.abs(y - pred))


def inverse_error_vote(votes: DataFrame, idx: str) -> DataFrame:
    """(idx, pred, error) -> the mean of the predictions, weighted by 1 / (error + 1e-9); a null error
    has no say unless all are null, when all count the same."""
    w = F.when(F.col("error").isNotNull(), 1 / (F.col("error") + 1e-9))
    return votes.groupBy(idx).agg(F.coalesce(F.sum(w * F.col("pred")) / F.sum(w), F.avg("pred")).alias("vote"), F.coalesce(F.sum(w * F.col("error")) / F.sum(w), F.lit(-1.0)).alias("weighted_error"))


def uniform_vote(votes: DataFrame, idx: str) -> DataFrame:
    return votes.groupBy(idx).agg(F.avg("pred").alias("vote"))


def target_mean(df: DataFrame, key: str, order: str, y: str) -> DataFrame:
    """Adds `pred`, the mean of a key's earlier targets (0 at first)."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("pred", F.coalesce(F.avg(y).over(before), F.lit(0.0)))


class Perceptron:
    """Linear model on standardised inputs and target, by the delta rule with a decaying rate.

    A missing input (NaN) counts in no moments, and as its mean in the product.
    """

    def __init__(self, n: int, rate: float = 0.025, decay: float = 0.001, fade: float = 0.99, seed: int = 1):
        self.rate, self.decay, self.fade, self.n = rate, decay, fade, 0
        self._w = (2 * np.random.default_rng(seed).random(n + 1) - 1).tolist()
        # rows, sums and squares of each input and of the target; means and deviations that follow from them
        self._sums, self._stats = [[0, 0.0, 0.0] for _ in range(n)], [(0.0, 0.0)] * n
        self._target, self._scale = [0, 0.0, 0.0], (0.0, 0.0)
        self.error = self.seen = 0.0

    @property
    def w(self) -> np.ndarray:
        return np.array(self._w)

    @property
    def s(self) -> np.ndarray:
        """Rows, sums and squares of the inputs."""
        return np.array(self._sums, float).T

    @property
    def stats(self) -> list[tuple[float, float]]:
        """Mean and standard deviation of each input."""
        return self._stats

    @staticmethod
    def _added(s: list, v: float) -> tuple[float, float]:
        """The mean and the deviation after one more value."""
        s[0] += 1
        s[1] += v
        s[2] += v * v
        mean = s[1] / s[0]
        return mean, math.sqrt(max((s[2] - s[1] * mean) / max(s[0] - 1, 1), 0.0))

    def _z(self, x) -> list[float]:
        return [(v - mean) / sd if sd > 1e-7 and v == v else 0.0 for v, (mean, sd) in zip(x, self._stats)]

    def _output(self, z: list[float]) -> float:
        out = 0.0
        for w, v in zip(self._w[1:], z):
            out += w * v
        return self._w[0] + out

    def predict(self, x) -> float:
        mean, sd = self._scale
        return self._output(self._z(x)) * sd + mean

    def learn(self, x, y: float) -> None:
        self.error = abs(self.predict(x) - y) + self.fade * self.error
        self.seen = 1 + self.fade * self.seen
        self._stats = [self._added(s, v) if v == v else old for v, s, old in zip(x, self._sums, self._stats)]
        self._scale = mean, sd = self._added(self._target, y)
        self.n += 1
        if sd <= 1e-7:
            return
        z = self._z(x)
        step = self.rate / (1 + self.n * self.decay) * ((y - mean) / sd - self._output(z))
        self._w = [self._w[0] + step, *(w + step * v for w, v in zip(self._w[1:], z))]
        size = sum(map(abs, self._w))
        if size > len(self._w) - 1:
            self._w = [w / size for w in self._w]

    @property
    def faded_error(self) -> float:
        return self.error / self.seen if self.seen else math.inf


def perceptron(df: DataFrame, key: str, order: str, x: list[str], y: str) -> DataFrame:
    """Test-then-train of one perceptron per key: key, order, pred, error; rows stream through the fold."""
    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, order, F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(x))).na.drop().repartition(key).sortWithinPartitions(key, order)

    def run(batches):
        last, model = object(), None
        for batch in batches:
            inputs = zip(*(batch.column(3 + k).to_pylist() for k in range(len(x))))
            out: list[list] = [[], []]
            for k, target, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), inputs):
                if model is None or k != last:
                    last, model = k, Perceptron(len(x))
                out[0].append(model.predict(row))
                model.learn(row, target)
                out[1].append(model.faded_error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.float64()) for v in out)], [key, order, "pred", "error"])

    return dealt.mapInArrow(run, f"{key} {kind}, {order} long, pred double, error double")


@dataclass
class LearnedRule(Rule):
    n: float = 0.0
    mean: float = 0.0
    error: float = math.inf
    seen: int = 0
    deviation: float = 0.0
    least_deviation: float = 0.0
    stats: DataFrame | None = None


class AMRules:
    """Adaptive model rules for regression, as a loop over micro-batches.

    The rules are fixed within a batch.  After it, one grouped aggregate gives, for each rule and
    attribute, the target's sums over `bins` equal-width bins of the attribute's known range; prefix
    sums over the bins are the candidate literals.  A rule that meets the Hoeffding bound on the ratio
    of the two best reductions of the standard deviation takes the literal of the better branch; the
    default rule becomes a new rule and starts anew.  A rule whose error passes the Page-Hinkley bar goes.
    Rows without a target are not learned; a missing attribute counts in no bin, as no literal covers it.
    `online.Rules` is the row-by-row form, with perceptrons, anomaly test and a change test on every row.
    """

    def __init__(self, attributes: list[str], ranges: dict[str, tuple[float, float]], delta: float = 1e-7, tie: float = 0.05, grace: int = 200, bins: int = 32, ordered: bool = True, bar: float = 35.0, ph_delta: float = 0.005):
        self.attributes, self.ranges, self.delta, self.tie, self.grace = attributes, ranges, delta, tie, grace
        self.bins, self.ordered, self.bar, self.ph_delta = bins, ordered, bar, ph_delta
        self.rules: list[LearnedRule] = []
        self.default = LearnedRule()
        self.sums: dict[int, np.ndarray] = {}

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `rule` (-1 for the default) and `pred`; unordered rules vote by inverse error."""
        means = F.array(*(F.lit(float(r.mean)) for r in [*self.rules, self.default]))
        pick = lambda k: F.get(means, F.when(k < 0, len(self.rules)).otherwise(k))
        first = df.withColumn("rule", first_cover(self.rules))
        if self.ordered or not self.rules:
            return first.withColumn("pred", pick(F.col("rule")))
        weights = F.array(*(F.lit(0.0 if math.isinf(r.error) else 1 / (r.error + 1e-9)) for r in self.rules))
        total = F.aggregate("hit", F.lit(0.0), lambda s, k: s + F.get(weights, k))
        vote = F.aggregate("hit", F.lit(0.0), lambda s, k: s + F.get(weights, k) * F.get(means, k)) / F.nullif(total, F.lit(0.0))
        return first.withColumn("hit", all_covers(self.rules)).withColumn("pred", F.when(F.col("rule") < 0, pick(F.lit(-1))).otherwise(F.coalesce(vote, pick(F.col("rule"))))).drop("hit")

    def learn(self, df: DataFrame, y: str) -> AMRules:
        """One micro-batch."""
        n, own = len(self.rules), len(self.attributes)
        rows = self.predict(df.where(F.col(y).isNotNull()))
        # a row stands for itself once, as one more attribute, and in the bin of each attribute that it has
        bins = [*((k, self._bin(a)) for k, a in enumerate(self.attributes)), (own, F.lit(0))]
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("a"), b.alias("bin")) for k, b in bins)))
        tall = rows.select("rule", F.col(y).cast("double").alias("y"), F.abs(F.col(y) - F.col("pred")).alias("e"), pairs.alias("p")).select("rule", "y", "e", "p.a", "p.bin").where("bin is not null")
        # at most rules x attributes x bins rows
        cells = tall.groupBy("rule", "a", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"), F.sum("e").alias("e")).collect()
        fresh: dict[int, np.ndarray] = {}
        errors: dict[int, list[float]] = {}
        for r in cells:
            fresh.setdefault(r.rule, np.zeros((own + 1, self.bins, 3)))[r.a, r.bin] += (r.n, r.s, r.q)
            if r.a == own:
                errors[r.rule] = [r.n, r.e]
        gone = []
        for k in [*range(n), -1]:
            rule = self.rules[k] if k >= 0 else self.default
            if k in fresh:
                rule.stats = fresh[k] if rule.stats is None else rule.stats + fresh[k]
                total = rule.stats[own, 0]
                error = errors[k][1] / errors[k][0]
                rule.seen += errors[k][0]
                if not math.isinf(rule.error) and rule.error > 0:
                    rule.deviation += errors[k][0] * (error / rule.error - 1 - self.ph_delta)
                    rule.least_deviation = min(rule.least_deviation, rule.deviation)
                    if k >= 0 and rule.n > 30 and rule.deviation - rule.least_deviation > self.bar * 10:
                        gone.append(k)
                rule.n, rule.mean = float(total[0]), float(total[1] / total[0])
                rule.error = error if math.isinf(rule.error) else 0.5 * (rule.error + error)
                if rule.seen >= self.grace:
                    rule.seen = 0
                    self._expand(k)
        self.rules = [r for k, r in enumerate(self.rules) if k not in gone]
        return self

    def _bin(self, a: str) -> Column:
        low, high = self.ranges[a]
        at = F.floor((F.col(a) - low) / ((high - low) or 1.0) * self.bins)
        return F.when(F.col(a).isNotNull(), F.least(F.greatest(at, F.lit(0)), F.lit(self.bins - 1))).cast("int")

    def _expand(self, k: int) -> None:
        rule = self.rules[k] if k >= 0 else self.default
        best = []
        for i, a in enumerate(self.attributes):
            left = rule.stats[i].cumsum(0)
            total, left = left[-1], left[:-1]
            if total[0] <= 0:
                continue
            right = total - left
            ok = np.minimum(left[:, 0], right[:, 0]) >= max(0.05 * total[0], 1)
            if not ok.any():
                continue
            sd = lambda s: np.sqrt(np.maximum(s[..., 2] - s[..., 1] ** 2 / np.maximum(s[..., 0], 1), 0) / np.maximum(s[..., 0], 1))
            merit = np.where(ok, sd(total) - left[:, 0] / total[0] * sd(left) - right[:, 0] / total[0] * sd(right), -np.inf)
            at = int(merit.argmax())
            low, high = self.ranges[a]
            cut = low + (high - low) * (at + 1) / self.bins
            better = AT_MOST if left[at, 0] * sd(left)[at] <= right[at, 0] * sd(right)[at] else ABOVE
            best.append((float(merit[at]), a, better, cut))
        best.sort(reverse=True)
        if not best or best[0][0] <= 0:
            return
        epsilon = math.sqrt(math.log(1 / self.delta) / (2 * rule.n))
        if len(best) > 1 and not (best[1][0] / best[0][0] + epsilon < 1 or epsilon < self.tie):
            return
        _, a, operator, cut = best[0]
        if k >= 0:
            rule.add(a, operator, cut)
            rule.stats, rule.error = None, math.inf
        else:
            new = LearnedRule([(a, operator, cut)], mean=rule.mean)
            self.rules.append(new)
            self.default = LearnedRule(mean=rule.mean)
