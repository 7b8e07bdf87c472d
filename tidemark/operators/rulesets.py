"""Adaptive model rules learned in parallel by replicated rule sets, and an index for sets of many rules.

A rule is a box: each attribute lies above `low` and at or below `high`.  `RuleIndex` holds, for each attribute, its sorted cuts and
for each interval between them a bitmap of the rules that are satisfied there; the rules that cover a row are the intersection
of one bitmap an attribute, so a row costs a search and a few words an attribute, not a test a rule.

`RuleSet` is a versioned table of rules.  Every micro-batch reads one version, sent to all tasks: each task's copy covers and predicts
its rows, leaves out anomalies, and sums up what each rule is to learn (the default rule too, however many rows it gets), by rule
and attribute.  One grouped aggregate merges the tasks' sums.  The learners' answers (new rules, new literals, rules that go)
make the next version and are written to a log.  All that is learned is additive: target sums by bins of each attribute, moments,
cross products for the linear predictor, and errors; so the rules do not depend on how rows lie in partitions.

Missing values (null, NaN) satisfy no literal, fall in no bin and count in no moments; in the linear predictor they stand for the
middle of their range.  A row of weight 2 is that row twice; rows without a target are predicted and not learned.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import ABOVE, AT_MOST, Rule

#: Rows that are covered together.
CHUNK = 4096


class RuleIndex:
    """Bitmaps of the rules that an interval of an attribute satisfies; `low` and `high` are rules x attributes."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.size = len(low)
        self.cuts, self.maps = [], []
        for a in range(low.shape[1]):
            lo, hi = low[:, a], high[:, a]
            cuts = np.unique(np.concatenate([lo[np.isfinite(lo)], hi[np.isfinite(hi)]]))
            begins, ends = np.concatenate([[-np.inf], cuts]), np.concatenate([cuts, [np.inf]])
            packed = [np.packbits((lo[None, :] <= begins[i : i + 512, None]) & (hi[None, :] >= ends[i : i + 512, None]), axis=1) for i in range(0, len(begins), 512)]
            free = np.packbits(~np.isfinite(lo) & ~np.isfinite(hi))
            self.cuts.append(cuts)
            self.maps.append(np.concatenate([*packed, free[None, :]]))  # the last one is of missing values

    @classmethod
    def of(cls, rules: list[Rule], attributes: list[str]) -> RuleIndex:
        low, high = np.full((len(rules), len(attributes)), -np.inf), np.full((len(rules), len(attributes)), np.inf)
        for k, rule in enumerate(rules):
            for a, operator, value in rule.literals:
                j = attributes.index(a)
                if operator == AT_MOST:
                    high[k, j] = min(high[k, j], value)
                else:
                    low[k, j] = max(low[k, j], value)
        return cls(low, high)

    def covers(self, x: np.ndarray) -> np.ndarray:
        """A bitmap of rules for each row (rows x attributes)."""
        out = np.full((len(x), (self.size + 7) // 8), 255, np.uint8)
        for a, (cuts, maps) in enumerate(zip(self.cuts, self.maps)):
            v = x[:, a]
            out &= maps[np.where(np.isnan(v), len(maps) - 1, np.searchsorted(cuts, v, "left"))]
        if self.size % 8:
            out[:, -1] &= 256 - (1 << (8 - self.size % 8))
        return out

    @staticmethod
    def first(bits: np.ndarray) -> np.ndarray:
        """Number of the first covering rule of each row, -1 for none."""
        if not bits.shape[1]:
            return np.full(len(bits), -1)
        at = (bits != 0).argmax(1)
        byte = bits[np.arange(len(bits)), at]
        return np.where(byte > 0, 8 * at + 7 - np.frexp(np.maximum(byte, 1).astype(float))[1] + 1, -1)

    def all(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, rule) of every cover."""
        return np.nonzero(np.unpackbits(bits, axis=1, count=self.size))


def covered(df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """`keep`, rule (the first that covers a row, -1 for none) and covers (how many do), for any number of rules."""
    attributes = sorted({a for r in rules for a, _, _ in r.literals})
    held = df.sparkSession.sparkContext.broadcast(RuleIndex.of(rules, attributes))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    rows = df.select(*keep, F.array(*(F.col(a).cast("double") for a in attributes)).alias("_x"))

    def run(batches):
        index = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                bits = index.covers(_matrix(part.column(len(keep)), len(attributes)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(index.first(bits), pa.int32()), pa.array(np.bitwise_count(bits).sum(1), pa.int32())], [*keep, "rule", "covers"])

    return rows.mapInArrow(run, f"{schema}, rule int, covers int")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


#: What a batch's pass gives: predictions (part row), and what a rule is to learn (part cube) by partition.
PASSED = "part string, idx long, y double, pred double, rule int, sums array<double>"
_NAMES = [c.split()[0] for c in PASSED.split(", ")]
LOG = "batch int, event string, rule int, attribute string, operator string, cut double"


class Known:
    """A rule and what it has learned since it last changed."""

    def __init__(self, number: int, width: int, bins: int, low=None, high=None, base=(0.0, 0.0)):
        self.number, self.low, self.high = number, np.full(width, -np.inf) if low is None else low, np.full(width, np.inf) if high is None else high
        self.base = np.array(base, float)  # weight and sum of the target that it starts from
        self.cells = np.zeros((width, bins, 3))
        self.moments = np.zeros((width, 3))
        self.gram = np.zeros((width + 1, width + 2))
        self.total = np.zeros(3)
        self.missed, self.seen = np.zeros(2), 0.0  # faded errors of the mean and the linear predictor, and their weight
        self.unchecked = 0.0
        self.test = [0.0, 0.0]

    STATE = ("low", "high", "base", "cells", "moments", "gram", "total", "missed")

    def mean(self) -> float:
        n, s = self.base[0] + self.total[0], self.base[1] + self.total[1]
        return float(s / n) if n > 0 else 0.0

    def sd(self) -> float:
        n, s, q = self.total
        return math.sqrt(max(q - s * s / n, 0.0) / (n - 1)) if n > 1 else 0.0

    def line(self) -> np.ndarray:
        """Least squares, drawn slightly towards the mean."""
        a, b = self.gram[:, :-1], self.gram[:, -1]
        ridge = np.eye(len(a)) * (1e-6 * max(self.total[0], 1.0))
        ridge[0, 0] = 0.0 if self.total[0] > 0 else 1.0
        return np.linalg.solve(a + ridge, b)


class RuleSet:
    """Versions of a rule table; `rise` is the change test's bar on a batch's normalised error (none: no rule goes)."""

    def __init__(self, attributes: list[str], ranges: dict[str, tuple[float, float]], grace: int = 200, delta: float = 1e-7, tie: float = 0.05, bins: int = 32, ordered: bool = True, predictor: str = "adaptive", anomalies: bool = True, rise: float | None = None, fade: float = 0.8, max_rules: int = 1000):
        if predictor not in ("mean", "linear", "adaptive"):
            raise ValueError(f"no predictor {predictor!r}")
        self.attributes, self.grace, self.delta, self.tie, self.bins, self.ordered = list(attributes), grace, delta, tie, bins, ordered
        self.predictor, self.anomalies, self.rise, self.fade, self.max_rules = predictor, anomalies, rise, fade, max_rules
        self.low, self.high = (np.array([float(ranges[a][k]) for a in attributes]) for k in (0, 1))
        self.rules: list[Known] = []
        self.default, self.made, self.version = self._known(), 0, 0
        self.log: list[tuple] = []

    @property
    def columns(self) -> list[str]:
        return self.attributes

    def _known(self, number: int = 0, **more) -> Known:
        return Known(number, len(self.attributes), self.bins, **more)

    # ---- one batch of rows, in a task

    def _linear(self, rule: Known) -> bool:
        return self.predictor == "linear" or self.predictor == "adaptive" and rule.seen > 0 and rule.missed[1] < rule.missed[0]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        half = np.where(self.high > self.low, (self.high - self.low) / 2, 1.0)
        return np.c_[np.ones(len(x)), np.nan_to_num((x - (self.low + self.high) / 2) / half)]

    def _deviates(self, rule: Known, x: np.ndarray, univariate: float = 0.1, multivariate: float = 0.99, least: int = 30) -> np.ndarray:
        """Rows whose improbable attributes make up nearly all of their log improbability."""
        n, s, q = rule.moments.T
        mean = s / np.maximum(n, 1)
        sd = np.sqrt(np.maximum(q - s * mean, 0) / np.maximum(n - 1, 1))
        ok = (sd > 0) & (n >= least) & ~np.isnan(x)
        p = 1 / (1 + (np.where(ok, x - mean, 0.0) / np.where(sd > 0, sd, 1.0)) ** 2)
        logs = np.where(ok, np.abs(np.log(p)), 0.0)
        total = logs.sum(1)
        return (total > 0) & ((logs * (p < univariate)).sum(1) >= multivariate * total)

    def passed(self, batches: Iterator[pa.RecordBatch], learning: bool = True) -> Iterator[pa.RecordBatch]:
        """Predictions of all rows (idx, y, weight, x), and at the end the sums of those that each rule is to learn."""
        width, every = len(self.attributes), [*self.rules, self.default]
        index = RuleIndex(np.array([r.low for r in self.rules]).reshape(-1, width), np.array([r.high for r in self.rules]).reshape(-1, width))
        means, lines = np.array([r.mean() for r in every]), [r.line() for r in every]
        linear, sds = np.array([self._linear(r) for r in every]), np.array([r.sd() for r in every])
        errors = np.array([r.missed[int(v)] / r.seen if r.seen else np.nan for r, v in zip(every, linear)])
        sums = {}
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                n, x = batch.num_rows, _matrix(batch.column("x"), width)
                y, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "weight"))
                bits, z = index.covers(x), self._scaled(x)
                first = index.first(bits)
                if self.ordered:
                    row, rule = np.arange(n), np.where(first < 0, len(self.rules), first)
                else:
                    row, rule = index.all(bits)
                    none = np.flatnonzero(first < 0)
                    row, rule = np.concatenate([row, none]), np.concatenate([rule, np.full(len(none), len(self.rules))])
                by_mean, by_line = means[rule], np.empty(len(rule))
                for k in np.unique(rule):
                    of = rule == k
                    by_line[of] = z[row[of]] @ lines[k]
                told = np.where(linear[rule], by_line, by_mean)
                # rules vote by inverse error; where none has one yet, all count the same
                vote = np.where(np.isnan(errors[rule]), 0.0, 1 / (np.nan_to_num(errors[rule]) + 1e-9))
                whole_vote = np.bincount(row, vote, n)
                vote = np.where(whole_vote[row] > 0, vote, 1.0)
                pred = np.bincount(row, vote * told, n) / np.bincount(row, vote, n)
                none = lambda kind: pa.nulls(n, kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(["row"] * n, pa.string()), batch.column("idx"), batch.column("y"), pa.array(pred), pa.array([every[k].number for k in np.where(first < 0, len(self.rules), first).tolist()], pa.int32()), none(pa.list_(pa.float64()))], _NAMES)
                if not learning:
                    continue
                for k in np.unique(rule).tolist():
                    of = np.flatnonzero((rule == k) & ~np.isnan(y[row]) & (weight[row] > 0))
                    if self.anomalies and k < len(self.rules):
                        of = of[~self._deviates(every[k], x[row[of]])]
                    if len(of):
                        at_row = row[of]
                        got = self._sums(x[at_row], z[at_row], y[at_row], weight[at_row], by_mean[of], by_line[of], told[of], sds[k])
                        sums[k] = sums[k] + got if k in sums else got
        if learning:
            n = len(sums)
            arrays = [pa.array(["cube"] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([every[k].number for k in sums], pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    def _sums(self, x, z, y, w, by_mean, by_line, told, sd) -> np.ndarray:
        """One vector of all that a rule learns from rows: cells, moments, cross products, target, errors."""
        width, target = x.shape[1], np.stack([w, w * y, w * y * y], 1)
        cells, moments = np.zeros((width, self.bins, 3)), np.zeros((width, 3))
        for a in range(width):
            known = ~np.isnan(x[:, a])
            v = x[known, a]
            # a bin is closed above, as literals are
            span = self.high[a] - self.low[a] or 1.0
            at = np.clip(np.ceil((v - self.low[a]) / span * self.bins).astype(np.int64) - 1, 0, self.bins - 1)
            np.add.at(cells[a], at, target[known])
            moments[a] = (w[known].sum(), (w[known] * v).sum(), (w[known] * v * v).sum())
        gram = (z * w[:, None]).T @ np.c_[z, y]
        scaled = np.abs(y - told) / sd if sd > 1e-7 else np.zeros(len(y))
        errors = [(w * np.abs(y - by_mean)).sum(), (w * np.abs(y - by_line)).sum(), (w * scaled).sum()]
        return np.concatenate([cells.ravel(), moments.ravel(), gram.ravel(), target.sum(0), errors])

    # ---- a batch of a table

    def prepared(self, df: DataFrame, order: str, y: str, weight: str | None = None) -> DataFrame:
        w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
        return df.select(F.col(order).cast("long").alias("idx"), F.col(y).cast("double").alias("y"), w.alias("weight"), F.array(*(F.col(a).cast("double") for a in self.attributes)).alias("x"))

    def predict(self, df: DataFrame, order: str, y: str) -> DataFrame:
        """idx, y, pred and the number of the first covering rule (0: the default) by this version."""
        held = df.sparkSession.sparkContext.broadcast(self)
        return self.prepared(df, order, y).mapInArrow(lambda batches: held.value.passed(batches, False), PASSED).select("idx", "y", "pred", "rule")

    def test_then_learn(self, df: DataFrame, order: str, y: str, folder: str, weight: str | None = None) -> RuleSet:
        """Writes the predictions of a batch to `folder`, as part=row, and makes the next version."""
        spark = df.sparkSession
        held = spark.sparkContext.broadcast(self)
        self.prepared(df, order, y, weight).mapInArrow(lambda batches: held.value.passed(batches), PASSED).write.partitionBy("part").parquet(folder)
        held.unpersist()
        cube = spark.read.schema(PASSED).parquet(folder).where("part = 'cube'").select("rule", F.posexplode("sums").alias("i", "v"))
        found: dict[int, dict[int, float]] = {}
        for r in cube.groupBy("rule", "i").agg(F.sum("v").alias("v")).where("v != 0").collect():  # rules x attributes x bins
            found.setdefault(r.rule, {})[r.i] = r.v
        return self.learn(found)

    def learn(self, found: dict[int, dict[int, float]]) -> RuleSet:
        """Takes up the merged sums of a batch (rule -> place -> sum), and answers with the next version."""
        width, bins = len(self.attributes), self.bins
        sizes = np.cumsum([width * bins * 3, width * 3, (width + 1) * (width + 2), 3, 3])
        gone, made = [], []
        for rule in [*self.rules, self.default]:
            if rule.number not in found:
                continue
            vector = np.zeros(sizes[-1])
            vector[list(found[rule.number])] = list(found[rule.number].values())
            cells, moments, gram, total, errors = np.split(vector, sizes[:-1])
            if self._changed(rule, total[0], errors[2]):
                gone.append(rule)
                self._note("removed", rule)
                continue
            rule.cells += cells.reshape(width, bins, 3)
            rule.moments += moments.reshape(width, 3)
            rule.gram += gram.reshape(width + 1, width + 2)
            rule.total += total
            rule.missed = self.fade * rule.missed + errors[:2]
            rule.seen = self.fade * rule.seen + total[0]
            rule.unchecked += total[0]
            if rule.unchecked >= self.grace:
                rule.unchecked = 0.0
                made += self._expanded(rule)
        self.rules = [r for r in self.rules if r not in gone] + made
        self.version += 1
        return self

    def _note(self, event: str, rule: Known, attribute: int | None = None, operator: int | None = None, cut: float | None = None) -> None:
        sign = {AT_MOST: "<=", ABOVE: ">"}
        self.log.append((self.version, event, rule.number, None if attribute is None else self.attributes[attribute], sign.get(operator), cut))

    def _changed(self, rule: Known, n: float, scaled: float) -> bool:
        """One step of the change test: a batch's mean normalised error far above the faded mean of those before."""
        if self.rise is None or rule is self.default or n <= 0 or not rule.sd() > 1e-7:
            return False
        x, (seen, mean) = scaled / n, rule.test
        rule.test = [self.fade * seen + 1, (self.fade * seen * mean + x) / (self.fade * seen + 1)]
        return seen > 0 and x > mean + self.rise

    def _best_cuts(self, rule: Known) -> list[tuple]:
        """(merit, attribute, bin, sums below, sums above), the best cut of each attribute, best first."""
        out = []
        sd = lambda s: np.sqrt(np.maximum(s[..., 2] - s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300), 0) / np.maximum(s[..., 0], 1e-300))
        for a in range(len(self.attributes)):
            below = rule.cells[a].cumsum(0)
            total, below = below[-1], below[:-1]
            above = total - below
            ok = np.minimum(below[:, 0], above[:, 0]) >= max(0.05 * total[0], 1e-9)
            if not ok.any():
                continue
            merit = np.where(ok, sd(total) - below[:, 0] / total[0] * sd(below) - above[:, 0] / total[0] * sd(above), -np.inf)
            # sums that differ in their last digits only are one cut
            at = int(np.round(merit, 9).argmax())
            out.append((float(merit[at]), a, at, below[at], above[at], float(sd(below[at])), float(sd(above[at]))))
        return sorted(out, key=lambda b: (-round(b[0], 9), b[1]))

    def _expanded(self, rule: Known) -> list[Known]:
        best = self._best_cuts(rule)
        if not best or best[0][0] <= 0:
            return []
        bound = math.sqrt(math.log(1 / self.delta) / (2 * rule.total[0]))
        if len(best) > 1 and not (best[1][0] / best[0][0] + bound < 1 or bound < self.tie):
            return []
        _, a, at, below, above, sd_below, sd_above = best[0]
        cut = float(self.low[a] + (self.high[a] - self.low[a]) * (at + 1) / self.bins)
        operator = AT_MOST if sd_below <= sd_above else ABOVE
        own, other = (below, above) if operator == AT_MOST else (above, below)
        low, high = rule.low.copy(), rule.high.copy()
        if operator == AT_MOST:
            high[a] = min(high[a], cut)
        else:
            low[a] = max(low[a], cut)
        if rule is self.default:
            if len(self.rules) >= self.max_rules:
                return []
            self.made += 1
            new = self._known(self.made, low=low, high=high, base=own[:2])
            self._note("new", new, a, operator, cut)
            self.default = self._known(base=other[:2])
            return [new]
        if (low == rule.low).all() and (high == rule.high).all():
            return []
        self._note("literal", rule, a, operator, cut)
        rule.__init__(rule.number, len(self.attributes), self.bins, low, high, own[:2])
        return []

    def logged(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, LOG)

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules of this version: version, rule, attribute, low, high, a row a bounded attribute."""
        bound = lambda v: float(v) if math.isfinite(v) else None
        rows = [(self.version, r.number, a, bound(r.low[k]), bound(r.high[k])) for r in self.rules for k, a in enumerate(self.attributes) if math.isfinite(r.low[k]) or math.isfinite(r.high[k])]
        return spark.createDataFrame(rows, "version int, rule int, attribute string, low double, high double")

    # ---- as text, for a store

    def to_json(self) -> str:
        told = lambda r: {"number": r.number, "seen": r.seen, "unchecked": r.unchecked, "test": r.test, **{s: getattr(r, s).tolist() for s in Known.STATE}}
        return json.dumps({"rules": [told(r) for r in self.rules], "default": told(self.default), "made": self.made, "version": self.version, "log": self.log})

    def restored(self, text: str) -> RuleSet:
        def known(told: dict) -> Known:
            out = self._known(told["number"])
            out.seen, out.unchecked, out.test = told["seen"], told["unchecked"], told["test"]
            for s in Known.STATE:
                setattr(out, s, np.array(told[s], float))
            return out

        told = json.loads(text)
        self.rules, self.default, self.made, self.version = [known(r) for r in told["rules"]], known(told["default"]), told["made"], told["version"]
        self.log = [tuple(r) for r in told["log"]]
        return self
