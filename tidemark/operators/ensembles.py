"""Online bagging and boosting, and combination of votes."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_uniform, poisson1


def bagging_weights(df: DataFrame, idx: str, models: int) -> DataFrame:
    """A row per instance and model with its Poisson(1) weight `k`, the same in every run."""
    out = df.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    return out.withColumn("k", poisson1(hash_uniform(F.col(idx).cast("string"), F.col("model").cast("string"))))


def bagged_counts(weighted: DataFrame, y: str) -> DataFrame:
    """Class weights of each model of a majority-class ensemble; rows of weight 0 are not learned."""
    return weighted.where("k > 0").groupBy("model", y).agg(F.sum("k").cast("long").alias("weight"))


def combined_votes(votes: DataFrame, idx: str, classes: int, weight: Column | None = None) -> DataFrame:
    """Votes (an array per instance and model) made to sum to one, weighted and added up per instance;
    a model whose votes sum to 0 or less does not count."""
    size = sum((F.get("votes", c) for c in range(1, classes)), F.get("votes", 0))
    weight = F.lit(1.0) if weight is None else weight
    return votes.groupBy(idx).agg(*(F.sum(F.when(size > 0, weight * F.get("votes", c) / size).otherwise(0.0)).alias(f"v{c}") for c in range(classes)))


def boosting_weight(correct: Column, wrong: Column) -> Column:
    """log((1 - e) / e) of the error share e; 0 where e is 0 or above one half."""
    e = wrong / (correct + wrong)
    return F.when((e > 0) & (e <= 0.5), F.log((1 - e) / e)).otherwise(0.0)


def poisson_sample(u: float, rate: float) -> int:
    """Poisson by inversion; a normal value rounded for large rates."""
    if rate <= 0:
        return 0
    if rate >= 100:
        return max(0, round(rate + math.sqrt(rate) * math.sqrt(-2 * math.log(max(u, 1e-12))) * math.cos(2 * math.pi * u)))
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u and k < 1000:
        k += 1
        term *= rate / k
        total += term
    return k


class Boosting:
    """Online boosting over majority-class models: the instance's rate grows at every model it fools.

    scms and swms, the rates seen when right and when wrong, and the weight seen by each model, all
    accumulate, as the published update has it.
    """

    def __init__(self, models: int, classes: int, uniform: Callable[[int, int], float]):
        self.models, self.classes, self.uniform = models, classes, uniform
        self.right, self.wrong, self.seen = [0.0] * models, [0.0] * models, [0.0] * models
        self.counts = [[0.0] * classes for _ in range(models)]

    def votes(self) -> list[float]:
        out = [0.0] * self.classes
        for m in range(self.models):
            e = self.wrong[m] / (self.right[m] + self.wrong[m]) if self.right[m] + self.wrong[m] else 0.0
            weight = math.log((1 - e) / e) if 0 < e <= 0.5 else 0.0
            total = sum(self.counts[m])
            if total > 0:
                for c in range(self.classes):
                    out[c] += weight * self.counts[m][c] / total
        return out

    def learn(self, idx: int, y: int) -> None:
        rate = 1.0
        for m in range(self.models):
            counts = self.counts[m]
            hit = counts.index(max(counts)) == y
            counts[y] += poisson_sample(self.uniform(idx, m), rate)
            self.seen[m] += rate
            if hit:
                self.right[m] += rate
                rate *= self.seen[m] / (2 * self.right[m])
            else:
                self.wrong[m] += rate
                rate *= self.seen[m] / (2 * self.wrong[m])


def _uniform(idx: int, model: int) -> float:
    import hashlib

    return int(hashlib.md5(f"{idx}|{model}".encode()).hexdigest()[:8], 16) / 2**32


def boosted(df: DataFrame, key: str, idx: str, y: str, models: int, classes: int) -> DataFrame:
    """Test-then-train of a boosted ensemble per key: key, idx, y, pred; rows stream through the fold."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    dealt = df.select(key, idx, y).repartition(key).sortWithinPartitions(key, idx)

    def run(batches):
        last, model = object(), None
        for batch in batches:
            pred = []
            for k, i, label in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if model is None or k != last:
                    last, model = k, Boosting(models, classes, _uniform)
                votes = model.votes()
                pred.append(votes.index(max(votes)))
                model.learn(i, label)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.int32())], [key, idx, y, "pred"])

    return dealt.mapInArrow(run, f"{key} {kinds[key]}, {idx} {kinds[idx]}, {y} {kinds[y]}, pred int")


def adaptive_bagged(df: DataFrame, key: str, idx: str, y: str, models: int, classes: int, detector) -> DataFrame:
    """Online bagging of majority-class models per key, each reset when its detector sees its error rise:
    key, idx, y, pred, resets so far."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    dealt = df.select(key, idx, y).repartition(key).sortWithinPartitions(key, idx)

    def run(batches):
        last, started = None, False
        for batch in batches:
            out: list[list] = [[], []]
            for k, i, label in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if not started or k != last:
                    last, started, resets = k, True, 0
                    counts = [[0.0] * classes for _ in range(models)]
                    states, estimates = [list(detector.init) for _ in range(models)], [0.0] * models
                votes = [0.0] * classes
                for c in counts:
                    total = sum(c)
                    for j in range(classes if total else 0):
                        votes[j] += c[j] / total
                out[0].append(votes.index(max(votes)))
                for m in range(models):
                    miss = float(counts[m].index(max(counts[m])) != label)
                    counts[m][label] += poisson_sample(_uniform(i, m), 1.0)
                    states[m], change, _, estimate = detector.step(states[m], miss)
                    if change and estimate > estimates[m]:
                        counts[m], states[m], resets = [0.0] * classes, list(detector.init), resets + 1
                        estimate = 0.0
                    estimates[m] = estimate
                out[1].append(resets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32())], [key, idx, y, "pred", "resets"])

    return dealt.mapInArrow(run, f"{key} {kinds[key]}, {idx} {kinds[idx]}, {y} {kinds[y]}, pred int, resets int")
